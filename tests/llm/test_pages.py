from strataloom.llm import langid, warc_revisit

WORDS = {"en": "the house and the river are near that old tree with many birds", "de": "das haus und der fluss sind nahe bei dem alten baum mit vielen voegeln", "fr": "la maison et la riviere sont pres de cet arbre ancien avec des oiseaux"}


def test_evidence_is_fused(spark):
    docs = spark.createDataFrame([(i, WORDS[k] + f" {i}", k) for i, k in enumerate(["en", "de", "fr"] * 10)] + [(99, None, "en"), (100, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    page = lambda lang, text: f'<html lang="{lang}"><body><p>{text}</p>'
    pages = [(i, f"https://www.site-{k}.{'de' if k == 'de' else 'org'}/{i}", page(k, WORDS[k])) for i, k in enumerate(["en", "de", "fr"] * 10)]
    pages += [(100, "https://www.site-de.de/x", page("de", "123")), (101, "https://www.site-fr.org/y", None), (102, None, page("en", WORDS["fr"])), (102, None, page("en", WORDS["fr"]))]
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, lang int"), model).collect()}
    assert len(got) == 33
    assert all(got[i].lang == ["en", "de", "fr"][i % 3] for i in range(30))
    assert got[100].lang == "de"  # markup, suffix and host decide
    assert got[101].lang == "fr"  # the host's prior decides
    assert got[102].lang == "fr"  # the text outweighs a wrong declaration


def test_without_a_model(spark):
    none = langid.train(spark.createDataFrame([], "text string, lang string"))
    pages = spark.createDataFrame([(1, "http://x.y", "<p>x")], "page_id long, url string, html string")
    assert langid.identify(pages, none).first().lang is None
    model = langid.train(spark.createDataFrame([("abc def", "en")], "text string, lang string"))
    assert langid.identify(pages.limit(0), model).count() == 0


SCHEMA = "record_id long, url string, kind string, at_s long, etag string, last_modified string, digest string, headers map<string,string>, extra int"


def brute(rows, slot=None):
    out = []
    for r in rows:
        if r[2] != "revisit":
            continue
        earlier = [x for x in rows if x[2] == "response" and x[1] == r[1] and r[1] is not None and x[3] is not None and r[3] is not None and x[3] < r[3]]
        best = max(earlier, key=lambda x: (x[3], x[0]), default=None)
        out.append((r[0], best and best[0]))
    return out


def test_as_of_join(spark):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "revisit"])
        rows.append((i, rng.choice(["https://a.org/x", "https://a.org/y", None]), kind, rng.choice([None, *range(0, 400, 3)]), rng.choice(['"1"', 'W/"1"', None]), rng.choice(["d1", "d2", None]), "p", {"date": str(i), "content-type": kind}, 1))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for slot in (7, 100, 10_000):
        got = warc_revisit.resolve(frame, slot).collect()
        assert sorted((r.record_id, r.response_id) for r in got) == sorted(brute(rows), key=lambda x: x[0])


def test_validators_and_headers(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://WWW.a.org:80/x/?utm_source=f#t", "response", 10, '"e"', "m", "p", h(date="1", content_type="html"), 1), (2, "https://a.org/x", "revisit", 20, 'W/"e"', "other", "q", h(date="2", content_type="bad"), 1),
        (3, "https://a.org/x", "revisit", 20, '"f"', "m", "p", h(), 1), (4, "https://a.org/x", "revisit", 10, '"e"', "m", "p", h(), 1), (5, "https://a.org/x", "revisit", 20, None, "m", "z", None, 1), (6, "https://a.org/x", "revisit", 20, None, None, "p", h(), 1),
    ]
    got = {r.record_id: r for r in warc_revisit.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r.status for k, r in got.items()} == {2: "resolved", 3: "validators differ", 4: "no earlier response", 5: "resolved", 6: "resolved"}
    assert got[2].headers == {"date": "2", "content-type": "html"} and got[5].headers == {"date": "1", "content-type": "html"}
    assert warc_revisit.resolve(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0
