"""Colliding strings, hot groups, very long texts, repeated rows and pages that are hard to read."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataloom.llm import decontam, html_mincut, langid, minhash, packing, quality_bt, quality_rules, suffix_dedup, warc_revisit
from strataloom.llm import shared as S

from .test_suffix_dedup import brute as brute_spans

PATH = public_tokenizers.path("word_bpe_49k.json")
#: A Thue-Morse word and its complement have one polynomial hash modulo 2^64, whatever the base.
MORSE = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))


def test_thue_morse_words_have_different_hashes():
    data, _ = S.text_bytes(pa.array([MORSE + OTHER]))
    a, b = S.span_hash(S.prefix_hash(data), np.array([0, 2048]), np.array([2048, 4096]))
    assert a != b


def test_hash_is_the_polynomial_modulo_the_prime():
    data = np.random.default_rng(3).integers(0, 256, 70_000, dtype=np.uint8)
    prefix, prime, total, power = S.prefix_hash(data), int(S.PRIME), 0, 1
    for i, x in enumerate(data.tolist()):
        if i in (1, 7, S.PART - 1, S.PART, S.PART + 1, 69_999):
            assert int(prefix[i]) == total
        total, power = (total + int(S.BYTE_CODE[x]) * power) % prime, power * S.BASE % prime
    assert (S.window_hash(prefix[:1001], 64) == S.span_hash(prefix[:1001], np.arange(937), np.arange(64, 1001))).all()


def test_thue_morse_words_in_the_operators(spark):
    docs = spark.createDataFrame([(1, f"{MORSE}\n{OTHER}\n" + "w " * 60), (2, OTHER), (3, MORSE)], "doc_id long, text string")
    lines = {r.doc_id: r.n_dup_lines for r in quality_rules.measure(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")})).collect()}
    assert lines == {1: 0, 2: 0, 3: 0}
    tokenizer = Tokenizer.from_file(PATH)
    for r in packing.pack(docs.filter("doc_id > 1"), PATH, longest=1 << 20).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("p")).collect():
        assert [i for p in r.p for i in p.ids] == tokenizer.encode(OTHER if r.doc_id == 2 else MORSE, add_special_tokens=False).ids + [1]
    found = decontam.decontaminate(docs, spark.createDataFrame([(7, MORSE)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_hit for r in found] == [1, 0, 1]
    assert [r.kept for r in minhash.near_dedup(docs).orderBy("doc_id").collect()] == [True, True, True]


def test_packing_survives_a_useless_hash(monkeypatch):
    monkeypatch.setattr(S, "span_hash", lambda prefix, start, end: (end - start).astype(np.uint64))
    words, tokenizer = packing.Words(PATH), Tokenizer.from_file(PATH)
    for texts in (["the cat sat on the mat", "dog and cat", ""], ["the dog mat", "sat cat the on"]):
        data, offs = S.text_bytes(pa.array(texts))
        ids, first = packing.encoded(data, offs, words)
        for i, text in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_of_repeated_rows_long_texts_and_buckets(spark, tmp_path):
    long = "some words of a very long text, 12 times over. " * 60_000
    rows = packing.pack(spark.createDataFrame([(1, "same text"), (1, "same text"), (2, long)], "doc_id long, text string"), PATH)
    got = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.count_distinct("sequence_id").alias("sequences")).orderBy("doc_id").collect()
    one = len(Tokenizer.from_file(PATH).encode("same text", add_special_tokens=False).ids) + 1
    assert got[0].tokens == 2 * one and all(r.n == r.sequences for r in got)
    assert got[1].tokens == len(Tokenizer.from_file(PATH).encode(long, add_special_tokens=False).ids) + 1
    packing.write_buckets(rows, f"{tmp_path}/b")
    back = spark.read.parquet(f"{tmp_path}/b")
    assert back.count() == rows.count() and back.filter("bucket <> size(ids) or bucket <> length").count() == 0


@pytest.mark.parametrize("hot", [4, 4096])
def test_a_passage_in_many_different_documents(spark, hot):
    rng = random.Random(5)
    junk = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = junk(150)
    rows = [(i, junk(40) + passage + junk(40)) for i in range(120)] + [(7, junk(30) + passage), (500, (junk(90) + passage) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = suffix_dedup.suffix_dedup(docs, length=60, gram=16, hot=hot, with_text=False).collect()
    assert sorted(map(tuple, got)) == sorted(brute_spans(rows, 60))


def test_a_very_long_text_in_suffix_dedup(spark):
    body = "".join(random.Random(1).choices("abcdefghij ", k=700_000))
    rows = [(1, body), (2, body[300_000:300_500]), (3, "x" * 100)]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[3].n_removed) == (500, 1, 500, 0)
    assert got[1].kept_text == body[:300_000] + body[300_500:]


def test_a_window_that_very_many_items_and_documents_share(spark):
    prompt = "what is the capital of the country that is named in the question below"
    items = spark.range(4000).select(F.col("id").alias("item_id"), F.concat(F.lit(prompt + " "), F.col("id").cast("string")).alias("text"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("p" * 5 + " " + prompt + " q "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    got = decontam.digest(decontam.decontaminate(docs, items)).select("n_hit", "n_items").distinct().collect()
    assert [tuple(r) for r in got] == [(14, 4000)] and time.time() - began < 60


def test_a_very_long_text_in_decontamination(spark):
    words = random.Random(2).choices([f"w{i}" for i in range(5000)], k=500_000)
    items = [(1, " ".join(words[400_000:400_020])), (2, " ".join(words[7:9]))]
    got = decontam.decontaminate(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).first()
    assert got.n_words == 500_000 and {"s": 400_000, "e": 400_020} in [r.asDict() for r in got.hits] and got["items"] == ["1", "2"] and got.longest == 20


def test_very_long_texts_in_the_other_operators(spark):
    long = " ".join(random.Random(4).choices([f"word{i}" for i in range(3000)], k=300_000))
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, long + " end", "en", "s"), (3, "short one", "en", "s")], "doc_id long, text string, lang string, source string")
    assert [r.component_id for r in minhash.near_dedup(docs).orderBy("doc_id").collect()] == [1, 1, 3]
    assert [r.n_words for r in quality_rules.quality_rules(docs).orderBy("doc_id").collect()] == [300_000, 300_001, 2]
    assert quality_bt.quality(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")).count() == 3
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert {r.lang for r in langid.identify(pages, langid.train(docs)).collect()} == {"en"}
    assert html_mincut.extract(pages).filter("page_id = 1").first().n_chars == len(long)


def test_kept_is_what_exact_quantiles_say(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, n)))
    rows = [(i, rng.choice(["en", None]), rng.choice(["a", "b"]), " ".join(word(rng.choice([4, 4, 4, 30])) + rng.choice(["", "", "#"]) for _ in range(rng.randint(20, 200)))) for i in range(200)]
    rows += [(900, "en", "a", "\n".join(["one two three four five six seven"] * 3 + [" ".join(word(9) for _ in range(90))])), (901, None, None, None), (902, "en", "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    for reach in (0.5, 3.0):
        got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, reach).collect()}
        assert got == quality_rules.brute_kept(rows, reach) and len(set(got.values())) == 2


def test_conflicting_labels_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, ("fine plain words here now " if i % 2 else "### $$$ %% XX @@ ") * 9) for i in range(1, 60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(1, 60)]
    both = labels + [(i, 1 - i % 2) for i in range(1, 20)]
    a, b = (quality_bt.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (both, both[::-1]))
    c = quality_bt.fit(docs.union(docs), spark.createDataFrame(labels[19:], "doc_id long, quality int"))
    assert (a.weights == b.weights).all() and (a.weights == c.weights).all() and a.threshold is not None


def test_equal_responses_are_told_apart(spark):
    schema = "record_id long, url string, kind string, at_s long, etag string, last_modified string, digest string, headers map<string,string>"
    twins = [(1, "http://x.org/a", "response", 100, "e", None, "d", {"content-type": t}) for t in ("b", "a", "c")]
    revisits = [(2, "http://x.org/a", "revisit", 200, "e", None, "d", {"date": "1"}), (3, "http://x.org/a", "revisit", 90_000, "e", None, "d", {}), (3, "http://x.org/a", "revisit", 90_000, "e", None, "d", {})]
    for rows in (twins + revisits, revisits + twins[::-1]):
        got = sorted((r.record_id, r.headers) for r in warc_revisit.resolve(spark.createDataFrame(rows, schema).repartition(3)).collect())
        assert got == [(2, {"content-type": "c", "date": "1"}), (3, {"content-type": "c"}), (3, {"content-type": "c"})]


# --- pages --------------------------------------------------------------------------------------


def test_letters_that_grow_in_lower_case():
    page = "<p>" + "İ" * 60 + " opens it.</p><script>var x = 1;</script><p>The paragraph behind the script is long enough to be kept, is it not?</p>"
    assert html_mincut.main_text(page).split("\n")[1].startswith("The paragraph behind")


@pytest.mark.parametrize("part", ["<a ", "<div>x y z ", "<script ", "<svg>", "</x>", "<span class=ad>x ", "<main>x ", "<a \"'>", "<!-- ", "<head>", "<p><svg>", "<li>x"])
def test_time_is_linear_in_the_page(part):
    began = time.process_time()
    html_mincut.main_text(part * 60_000)
    langid.page_text(part * 60_000)
    langid.declared_language(part * 60_000)
    assert time.process_time() - began < 20


def test_the_cut_overturns_a_blocks_own_preference():
    long = "This sentence is part of an article that goes on for quite a while, as articles do, until it ends."
    inside = f"<div><p>{long}</p><p>{long}</p><span class=x></span><div>1,5 km</div><p>{long}</p><p>{long}</p></div>"
    links = "<div><a href=a>First section of it</a></div>" * 3
    outside = f"<div>{links}<div>Ten words about the site and what there is. Yes.</div>{links}</div>"
    blocks = html_mincut.blocks_of(inside + outside)
    turned = [(b.text, keep) for b, (own, keep) in zip(blocks, html_mincut.labelled(blocks)) if (own > 0) != keep]
    assert ("1,5 km", True) in turned


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 8)
        gain = [rng.choice([-2, -1, -0.5, 0.25, 1, 2.5]) * rng.random() for _ in range(n)]
        edges = {(i, j): rng.random() for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda label: sum(-g for g, x in zip(gain, label) if x) + sum(w for (i, j), w in edges.items() if label[i] != label[j])  # noqa: E731, B023
        assert abs(cost(html_mincut.min_cut(gain, edges)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-9


def test_repeated_pages_and_dropped_elements(spark):
    page = "<p>Water is <math><mi>H</mi>2<mi>O</mi></math> and it is wet, as everyone who has been in it will surely know.</p><noscript>Enable scripts</noscript>"
    rows = html_mincut.extract(spark.createDataFrame([(1, "u", page), (1, "u", page)], "page_id long, url string, html string")).collect()
    assert [r.text for r in rows] == ["Water is H2O and it is wet, as everyone who has been in it will surely know."] * 2


def test_fusion_is_bayes_rule(spark):
    """The posterior of each page against the same counts in plain Python."""
    docs = spark.createDataFrame([(1, "the cat and the dog with this", "en"), (2, "der hund und die katze mit dem", "de")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    html = [("a.org", "en", "the dog and this cat"), ("a.org", None, "the cat with the dog"), ("b.de", "de", "der hund und die katze"), ("b.de", "en", "die katze"), ("c.b.de", None, ""), ("", None, "the cat")]
    rows = [(i, f"http://{h}/" if h else None, f"<html lang={d}>{t}" if d else t) for i, (h, d, t) in enumerate(html)]
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    data = [S.text_bytes(pa.array([langid.page_text(r[2])])) for r in rows]
    like = [model.likelihoods(*x)[0] for x in data]
    langs = model.languages
    guess = [langs[int(x.argmax())] if x.any() else None for x in like]
    count = lambda want: [sum(g == x and want(i) for i, g in enumerate(guess)) for x in langs]
    total = count(lambda i: True)
    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    for i, (h, d, _) in enumerate(html):
        own = np.array([float(guess[i] == x) for x in langs])
        world = np.array([(x + 1) / (sum(total) + len(langs)) for x in total])
        of_domain = np.array(count(lambda j: domain(html[j][0]) == domain(h))) - own  # noqa: B023
        above = (of_domain + 20 * world) / (of_domain.sum() + 20)
        of_host = np.array(count(lambda j: html[j][0] == h)) - own  # noqa: B023
        prior = (of_host + 10 * above) / (of_host.sum() + 10)
        given = lambda want: (np.array(count(want)) + 1.0) / (np.array(total) + 50.0)  # noqa: E731, B023
        post = like[i] + np.log(prior) + np.log(given(lambda j: suffix(html[j][0]) == suffix(h))) + np.log(given(lambda j: html[j][1] == d))  # noqa: B023
        weight = np.exp(post - post.max())
        assert got[i].lang == langs[int(post.argmax())] and abs(got[i].confidence - 1 / weight.sum()) < 1e-9
