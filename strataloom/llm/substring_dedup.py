"""Substring dedup by seed and extend: remove every word of a window of `length` words that also starts earlier.

How it scales. The seeds are winnowed: of each window the word gram with the least hash. Two equal windows have the
same seed at the same place, so the windows of a document are cut into runs that share it (one run per some eight
words), and only the runs' hashes are shuffled:

1. a map over the texts emits (m, h, doc_id, v, place): seed, hash of the run's words, first word, windows;
2. seeds that occur once (and not twice in their own run, as in periodic text) are dropped after a partially
   aggregated count (a hot seed is one row a task);
3. runs with equal (m, h) match from end to end: all but the earliest are repeats, so thousands of copies are never
   compared with each other;
4. of seeds with several different runs, the earliest of each kind comes with its words. Each of its windows looks for
   the earliest equal one under this seed by a partially aggregated minimum over (m, window), so a hot seed is spread
   over all tasks; a window meets its leader only, never all its partners;
5. each match is joined with the leader's words and extended word by word to both sides; what is at least `length`
   words long is a maximal repeat within the two runs. Runs of neighbouring seeds overlap, so their union is whole.

Nothing is capped or sampled. Runs are compared by 61-bit hashes in addition to that of their seed, the rest by words.

Order: by doc_id (null last), then by the start. Rows that share a doc_id are documents of their own, in the order of a
hash of their texts; of equal rows one comes first. Null and empty texts have no words and the digest of nothing; texts
under `length` words are kept; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S
from .suffix_dedup import runs_of

LENGTH, GRAM = 20, 6
CHUNK = 1 << 20
MOST_WINDOWS = 255  # a longer run (periodic text) is cut; its parts meet again in their seed
KEY = ["doc_id", "v"]
OTHER = ["o_doc_id", "o_v"]


def word_table(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, the words before each document, prefix hashes over the words."""
    starts, ends, first = S.words(data, offs, S.NOT_SPACE)
    return starts, ends, first, S.prefix_of(S.span_hash(S.prefix_hash(data), starts, ends))


def cut_runs(length: int, gram: int):
    """Rows (doc_id, v, text): (m, h, doc_id, v, place) of each run, place holding lo, own and n in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offs, rows in S.chunks(batches, CHUNK):
            first, prefix = word_table(data, offs)[2:]
            doc, m, h, lo, n, own = runs_of(prefix, first, length, gram, MOST_WINDOWS)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(h), *(rows.column(k).take(take) for k in KEY), pa.array((lo << 16) | (own << 15) | n)], names=["m", "h", *KEY, "place"])

    return run


def unpacked(place: str) -> list:
    p = F.col(place)
    return [F.shiftright(p, 16).cast("int").alias("lo"), p.bitwiseAND(0x7FFF).cast("int").alias("n")]


RUNS = "m long, doc_id long, v long, lo int, words binary, fresh array<int>, hashes array<long>, again array<int>"


def cut_words(length: int):
    """Rows (doc_id, v, text, want): of each wanted run its words, joined by spaces; the starts and hashes of its windows
    that are the first of their kind there; and the starts of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offs, rows in S.chunks(batches, CHUNK):
            starts, ends, first, prefix = word_table(data, offs)
            want = rows.column("want")
            flat = want.flatten()
            lo, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "n"))
            who = np.repeat(np.arange(rows.num_rows), np.diff(want.offsets.to_numpy()))
            base = first[who] + lo
            raw = data.tobytes()
            words, fresh, hashes, again = [], [], [], []
            for s, size in zip(base.tolist(), n.tolist()):
                own = [raw[x:y] for x, y in zip(starts[s : s + size + length - 1].tolist(), ends[s : s + size + length - 1].tolist())]
                at = np.arange(s, s + size)
                h = S.span_hash(prefix, at, at + length).view(np.int64)
                seen: dict[int, int] = {}
                new, late = [], []
                for i, x in enumerate(h.tolist()):
                    j = seen.setdefault(x, i)
                    (late if j < i and own[j : j + length] == own[i : i + length] else new).append(i)
                words.append(b" ".join(own))
                fresh.append(new)
                hashes.append(h[new].tolist())
                again.append(late)
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [
                    flat.field("m"), *(rows.column(k).take(take) for k in KEY), pa.array(lo.astype(np.int32)), pa.array(words, pa.binary()),
                    *(pa.array(x, pa.list_(kind)) for x, kind in ((fresh, pa.int32()), (hashes, pa.int64()), (again, pa.int32()))),
                ],
                names=["m", *KEY, "lo", "words", "fresh", "hashes", "again"],
            )

    return run


def extend(length: int):
    """Rows (doc_id, v, lo, words, o_words, shift, seeds): the maximal repeats of two runs through the seeds.

    Word i of the run is compared with word i + shift of the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, low, high = [], [], []
            columns = [batch.column(k).to_pylist() for k in ("lo", "words", "o_words", "shift", "seeds")]
            for row, (lo, words, other, shift, seeds) in enumerate(zip(*columns)):
                a, b = words.split(b" "), other.split(b" ")
                end = 0
                for seed in sorted(seeds):
                    if seed + length <= end:
                        continue
                    s = e = seed
                    while s > 0 and s + shift > 0 and a[s - 1] == b[s - 1 + shift]:
                        s -= 1
                    while e < len(a) and e + shift < len(b) and a[e] == b[e + shift]:
                        e += 1
                    if e - s >= length:
                        who.append(row)
                        low.append(lo + s)
                        high.append(lo + e)
                        end = e
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in KEY), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=[*KEY, "s", "e"])

    return run


SPANS = "doc_id long, v long, s int, e int"


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, v, s, e): spans of words that are covered by windows which also start earlier; keyed has doc_id, v and text."""
    runs = keyed.filter(F.octet_length("text") >= 2 * length - 1).mapInArrow(cut_runs(length, gram), "m long, h long, doc_id long, v long, place long")
    own = F.shiftright("place", 15).bitwiseAND(1)
    twice = S.materialise(runs.groupBy("m").agg(F.sum(1 + own).alias("times")).filter("times > 1").select("m"))
    cand = S.materialise(runs.join(twice, "m"))
    by_run = S.materialise(cand.groupBy("m", "h").agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "place")).alias("one")))
    whole = cand.join(by_run.filter("times > 1").select("m", "h", "one"), ["m", "h"]).filter(F.struct(*KEY, "place") > F.col("one")).select(*KEY, *unpacked("place"))
    whole = whole.select(*KEY, F.col("lo").alias("s"), (F.col("lo") + F.col("n") + F.lit(length - 1)).alias("e"))
    kinds = S.materialise(by_run.groupBy("m").agg(F.sum(1 + F.shiftright("one.place", 15).bitwiseAND(1)).alias("kinds")).filter("kinds > 1").select("m"))
    want = by_run.join(kinds, "m").select("m", "one.*").select("m", *KEY, *unpacked("place"))
    per_row = want.groupBy(*KEY).agg(F.collect_list(F.struct("m", "lo", "n")).alias("want"))
    pieces = S.materialise(keyed.join(per_row, KEY).select(*KEY, "text", "want").mapInArrow(cut_words(length), RUNS))
    again = pieces.select(*KEY, "lo", F.explode("again").alias("at")).select(*KEY, (F.col("lo") + F.col("at")).alias("s"), (F.col("lo") + F.col("at") + F.lit(length)).alias("e"))
    windows = pieces.select("m", *KEY, "lo", F.explode(F.arrays_zip("fresh", "hashes")).alias("w")).select("m", F.col("w.hashes").alias("hash"), *KEY, "lo", F.col("w.fresh").alias("at"))
    place = F.struct(*KEY, (F.col("lo") + F.col("at")).alias("start"), "lo")
    windows = S.materialise(windows.select("m", "hash", place.alias("place")))
    leaders = windows.groupBy("m", "hash").agg(F.count("*").alias("times"), F.min("place").alias("first")).filter("times > 1").select("m", "hash", "first")
    met = windows.join(leaders, ["m", "hash"]).filter("place > first")
    met = met.select("m", *(F.col(f"place.{k}") for k in (*KEY, "lo")), *(F.col(f"first.{k}").alias(o) for k, o in zip((*KEY, "lo"), (*OTHER, "o_lo"))),
                     (F.col("place.start") - F.col("place.lo")).alias("at"), (F.col("first.start") - F.col("first.lo")).alias("o_at"))
    met = met.groupBy("m", *KEY, "lo", *OTHER, "o_lo", (F.col("o_at") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("seeds"))
    texts = pieces.select("m", *KEY, "lo", "words").dropDuplicates(["m", *KEY, "lo"])
    led = S.materialise(met.join(texts, ["m", *KEY, "lo"]))
    others = texts.select("m", *(F.col(k).alias(o) for k, o in zip((*KEY, "lo", "words"), (*OTHER, "o_lo", "o_words"))))
    pairs = led.join(S.materialise(others), ["m", *OTHER, "o_lo"]).select(*KEY, "lo", "words", "o_words", "shift", "seeds")
    return whole.unionByName(again).unionByName(pairs.mapInArrow(extend(length), SPANS))


def keep_rest(length: int, with_text: bool):
    """Rows (key, text, spans, late): counts and the digest of the words that are left, on demand the text and the spans.

    late: an equal row came before, so that every window is a repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offs, rows in S.chunks(batches, 1 << 22):
            starts, ends, first = S.words(data, offs, S.NOT_SPACE)
            raw = data.tobytes()
            counts = np.diff(first)
            removed, digest, texts, runs = [], [], [], []
            for i, (spans, late) in enumerate(zip(rows.column("spans").to_pylist(), rows.column("late").to_pylist())):
                gone = np.zeros(counts[i] + 1, np.int32)
                for x in spans or ():
                    gone[x["s"]] += 1
                    gone[x["e"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                if late and counts[i] >= length:
                    gone[:] = True
                keep = np.flatnonzero(~gone) + first[i]
                kept = b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())])
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    runs.append([{"first": int(s), "last": int(e) - 1} for s, e in zip(edge[::2], edge[1::2])])
            columns = [rows.column("key"), pa.array(counts), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                columns += [pa.array(texts, pa.string()), pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text", "removed"] * with_text])

    return run


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row; with_text adds kept_text and the removed runs of words."""
    last = 2**63 - 1  # stands for a null doc_id, which comes last
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keyed = docs.select(key.alias("key"), F.coalesce(key, F.lit(last)).alias("doc_id"), F.xxhash64(text, key.isNull()).alias("v"), text.alias("text"))
    spans = repeated_spans(keyed.select(*KEY, "text"), length, gram).groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    twins = S.materialise(keyed.groupBy(*KEY).agg(F.count("*").alias("copies")).filter("copies > 1"))
    single = keyed.join(twins, KEY, "left_anti").withColumn("late", F.lit(False))
    equal = keyed.join(twins.select(*KEY), KEY, "left_semi").groupBy("key", *KEY, "text").agg(F.count("*").cast("int").alias("copies"))
    equal = equal.select("key", *KEY, "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).withColumn("late", F.col("copy") > 1).drop("copy")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, removed array<struct<first: int, last: int>>" * with_text
    rows = single.unionByName(equal).join(spans, KEY, "left").select("key", "text", "spans", "late")
    return rows.mapInArrow(keep_rest(length, with_text), schema)
