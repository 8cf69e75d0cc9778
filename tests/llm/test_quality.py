import random
import zlib

from pyspark.sql import functions as F

from strataloom.llm import quality_bt as Q
from strataloom.llm import quality_rules as R


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(30, 200))]
        bad = rng.random() < 0.3
        if bad:
            w = [x + "$$$" for x in w] if i % 2 else [x for x in w for _ in range(5)]
        out.append((i, " ".join(w), int(not bad)))
    return out


def test_classifier_on_held_out_rows(spark):
    rows = texts(3, 600)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (9001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = Q.quality(docs, labels).collect()
    assert len(got) == 603
    want = {i: q for i, _, q in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [(r.predicted, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = texts(4, 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, Q.quality(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.quality(docs, none).collect()} == {0.5}
    assert Q.quality(docs.limit(0), none).count() == 0


def rules_rows():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "été", "cat#", "dog", "a", "b", "c", "$x"])
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one\x0btwo\x0cthree\r\nfour"), (5, "a a a a a"), (6, "x y z")]
    for i in range(7, 60):
        lines = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 12))]
        rows.append((i, "\n".join(lines + rng.sample(lines, rng.randint(0, len(lines))))))
    return rows + [rows[10], rows[10]]


def test_base_measures(spark):
    rows = rules_rows()
    docs = spark.createDataFrame([(i, t, None if i % 3 else "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_words int").repartition(3)
    got = R.quality_rules(docs).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(R.brute_force(rows))
    assert all(not r.kept for r in got if r.base_failed)
    assert R.quality_rules(docs.limit(0)).count() == 0


def test_thresholds_adapt_to_the_group(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for _ in range(80))
    rows = [(i, text(4), "en", "short") for i in range(100)] + [(200 + i, text(12), "de", "long") for i in range(100)] + [(500, text(12), "en", "short"), (501, text(12), "de", "long"), (502, text(12), "new", "group")]
    got = {r.doc_id: r.kept for r in R.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[500], got[501], got[502]) == (False, True, True)
    assert sum(got[i] for i in range(100)) == 100 and sum(got[200 + i] for i in range(100)) == 100


def test_repetition_is_rejected_below_the_base_rule(spark):
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]
    line = lambda n: " ".join(words(n))
    rows = [(i, "\n".join(line(15) for _ in range(10))) for i in range(100)]
    again = [line(3) for _ in range(4)]
    rows += [(200 + i, "\n".join([*(line(15) for _ in range(10)), *[again[i]] * (7 + i)])) for i in range(4)]  # 35 to 47 per cent repeated lines
    rows += [(300 + i, " ".join(words(45 + i) + words(10) * 4)) for i in range(6)]  # 42 to 48 per cent repeated words
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in R.quality_rules(docs).collect()}
    assert not any(failed for failed, _ in got.values())
    assert {i for i, (_, kept) in got.items() if kept} == set(range(100))


def test_sketches_merge(spark):
    rows = [(i, " ".join("ab" * (1 + i % 5) + str(i) + str(j) for j in range(60)), "en", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = R.measure(docs)
    parts = R.sketches(m.filter("doc_id < 30")).unionByName(R.sketches(m.filter("doc_id >= 30")))
    a, b = R.limits(R.merge_sketches(parts)).first(), R.limits(R.sketches(m)).first()
    assert abs(a.word_length_high - b.word_length_high) < 0.5
