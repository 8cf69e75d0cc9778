import random

import pytest

from strataloom.llm.decontam import brute_force, decontaminate, digest


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "cat", "été", "Sat", "on", "x9", "mat", "a", "dog"])
    para = lambda n: rng.choice([" ", ", "]).join(word() for _ in range(n))
    items = [(i, para(rng.randint(1, 40))) for i in range(2, 14)] + [(20, ""), (21, None), (22, "only"), (22, "two words"), (23, "...")]
    docs = [(1, None), (2, ""), (3, "ONLY"), (4, "the-cat " * 50)]
    for i in range(5, 60):
        own = [para(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            own += [rng.choice(items)[1] or "", para(rng.randint(0, 30))]
        docs.append((i, " ".join(own)))
    return docs + [docs[10], docs[10]], items


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 1 << 20), (3, 300)])
def test_same_as_brute_force(spark, seed, block):
    docs, items = made(seed)
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = digest(decontaminate(d, b, window=5, block_bytes=block)).drop("longest", "longest_item", "longest_at").collect()
    assert sorted(map(tuple, got)) == sorted(brute_force(docs, items, 5))


def test_longest_match(spark):
    d = spark.createDataFrame([(1, "p q r one two three four z"), (2, "nothing here")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "zero one two three four five")], "item_id long, text string")
    row = decontaminate(d, b, window=13).orderBy("doc_id").first()
    assert (row.longest, row.longest_item, row.longest_at, row.n_hit) == (4, "7", 3, 0)


def longest(docs, items):
    """Longest common run of words, its first place and the smallest item with it, in plain Python."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs: dict[tuple, str] = {}
    for i, t in items:
        w = split(t)
        for s in range(len(w)):
            for e in range(s + 1, len(w) + 1):
                runs[tuple(w[s:e])] = min(str(i), runs.get(tuple(w[s:e]), str(i)))
    out = []
    for i, t in docs:
        w, best = split(t), (0, None, None)
        for s in range(len(w)):
            n = best[0]
            while s + n < len(w) and tuple(w[s : s + n + 1]) in runs:
                n += 1
            if n > best[0]:
                best = (n, runs[tuple(w[s : s + n])], s)
        out.append((i, *best))
    return out


@pytest.mark.parametrize("seed,block,parts", [(1, 1 << 20, 1), (2, 1 << 20, 5), (4, 300, 2)])
def test_longest_match_of_documents_that_share_passages(spark, seed, block, parts):
    docs, items = made(seed)
    docs += [(100 + i, f"w{i} {items[3][1]} v{i}") for i in range(20)] + [(200 + i, "unseen words") for i in range(3)]
    items += [(30, items[3][1]), (8, f"{items[3][1]} more")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(d, b, window=5, block_bytes=block).select("doc_id", "longest", "longest_item", "longest_at").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, longest(docs, items)))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in digest(decontaminate(d, none)).collect()] == [(1, 2, 0)]
    assert decontaminate(d.limit(0), none).count() == 0


def test_items_without_an_id(spark):
    docs = [(1, "a b c d e f"), (2, "u v w x y z"), (3, "clean")]
    items = [(None, "a b c d e"), (7, "c d e f"), (None, "u v w x y z")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(d, b, window=4)
    assert {r.doc_id: r["items"] for r in got.collect()} == {1: ["", "7"], 2: [""], 3: []}
    want = sorted(brute_force(docs, items, 4))
    assert sorted(tuple(r)[:6] for r in digest(got).collect()) == want
