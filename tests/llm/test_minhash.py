import random

from strataloom.llm.components import components
from strataloom.llm.minhash import brute_force, near_dedup


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 2) + rng.choice("xyz")
    docs = [(1, None), (2, ""), (3, "two words"), (4, "TWO  words"), (5, "one\ttwo three four")]
    for i in range(10, 40):
        base = [word() for _ in range(rng.randint(4, 150))]
        docs.append((i * 100, " ".join(base)))
        for c in range(rng.randint(0, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = word()
            docs.append((i * 100 - c * 7 - 3, "\n".join(own)))
            base = own if rng.random() < 0.4 else base
    return docs


def test_same_as_brute_force(spark):
    docs = made(5)
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, component_id int").repartition(3)
    assert sorted(map(tuple, near_dedup(frame).collect())) == sorted(brute_force(docs))


def test_nulls_repeats_and_empty(spark):
    frame = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "A b c d e")], "doc_id long, text string")
    got = sorted(map(tuple, near_dedup(frame, shingle=4).collect()), key=str)
    assert got == sorted([(7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False), (None, 2, None, True)], key=str)
    assert near_dedup(frame.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}


def test_a_pair_between_four_and_five_words(spark):
    """Five of 200 words differ: similar by four-word shingles (0.82), not by the default of five (0.77)."""
    words = [f"w{i}" for i in range(200)]
    other = [f"x{i}" if i % 40 == 20 else w for i, w in enumerate(words)]
    docs = [(1, " ".join(words)), (2, " ".join(other))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for shingle, kept in ((4, [True, False]), (5, [True, True])):
        assert [r.kept for r in near_dedup(frame, shingle=shingle).orderBy("doc_id").collect()] == kept
        assert [x[3] for x in brute_force(docs, shingle)] == kept
    assert near_dedup(frame).filter("kept").count() == 2


def test_several_texts_under_one_doc_id(spark):
    """Each text has near copies elsewhere: no row is multiplied, and what either is linked with is one component."""
    first, second, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    docs = [(9, first), (9, second), (4, first + " end"), (12, second + " end"), (12, third), (20, third + " x"), (30, "alone with four words"), (9, first), (9, None)]
    for seed in (1, 2):
        rng = random.Random(seed)
        docs += [(rng.randint(100 * seed, 100 * seed + 25), t) for _, t in made(seed)[5:60]]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for shingle in (4, 5):
        assert sorted(map(tuple, near_dedup(frame, shingle=shingle).collect())) == sorted(brute_force(docs, shingle))
