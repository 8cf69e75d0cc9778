"""Hard negatives: for each anchor and each of its positives, the best rows of other labels that score just below it.

Method: a full sort of each anchor's scores. Vectors become integers, so scores are exact. The anchors, a stated query
set, are numbered and go out in blocks of bounded size; the rows stay where they are and pass them in chunks:

1. positives: each task scores its rows of an anchor's label, sorts them by score and id and keeps the first few; a
   window over (anchor) takes the first of all tasks;
2. negatives: each task scores its rows of other labels and sorts them (one number of score and place of id, so that
   the sort is that by score and id); a binary search finds each positive's upper limit, and the next rows above the
   lower limit are read; a window over (anchor, positive) takes the first of all tasks.

A task gives a few rows for each anchor and positive, however many rows it has read; it keeps one chunk's scores of
some anchors at a time. The number of tasks follows the cores, not the files. A block of anchors is the only thing that
is sent to all executors: at most `block_bytes`, the driver holds one block at a time; each further block is one more
pass over the rows. Sums are taken in the narrowest arithmetic that is exact for the values: float, double, 64-bit,
unbounded integers. A component or a score beyond 64 bits counts as the last number of that side.

Rows with a null label, a null vector or a component that is null or not finite take no part. A shorter vector counts
as if zeros followed; an empty one scores 0. A null id is no anchor and comes last among ties. Rows that share an id
are rows of their own, and one that equals the anchor is another row. An anchor without positives or negatives has no
rows. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

BLOCK_BYTES = 32 << 20
SCORES = 1 << 22  # that are sorted at once
TASKS_A_CORE = 4
SCALE = 256
NO_ID = 2**63 - 1  # a null id in arrays; a flag tells it from the number
FOUND = "anchor long, positive int, score long, vec_id long"


def integer_rows(df: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, q): the rows that take part, with floor(scale * x) of each component."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    made = df.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    whole = made.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    return whole.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))


def few_tasks(df: DataFrame) -> DataFrame:
    """df in a few tasks a core: each gives a few rows an anchor, so their number must not grow with the files."""
    n = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(n) if df.rdd.getNumPartitions() > n else df.repartition(n)


# --- scores -----------------------------------------------------------------------------------


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as an array of 64-bit integers, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0))
    if len(flat) == width * len(size):
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def most(q: np.ndarray) -> int:
    return max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0))))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b; beyond 64 bits the last number."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = most(a) * most(b) * width
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def sorted_scores(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row sorted by falling score, ties by column: (scores, columns)."""
    n = scores.shape[1]
    top, low = int(scores.max()), int(scores.min())
    if (top - low + 1) * n < 1 << 62:  # score and column in one number
        keys = (top - scores) * n + np.arange(n)
        keys.sort(axis=1)
        score, column = np.divmod(keys, n)
        return top - score, column
    column = np.argsort(~scores, axis=1, kind="stable")
    return np.take_along_axis(scores, column, 1), column


class Best:
    """The first `most` of what was offered to each of `n` lists, by falling score, then by id, null last."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.score, self.id = np.zeros((n, most), np.int64), np.full((n, most), NO_ID)
        self.none, self.free = np.ones((n, most), bool), np.ones((n, most), bool)  # no id; nothing there

    def offer(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray, free: np.ndarray) -> None:
        """To each of some lists, a row of candidates; free ones are none."""
        have = [np.concatenate([old[lists], new], axis=1) for old, new in ((self.score, score), (self.id, ids), (self.none, none), (self.free, free))]
        order = np.lexsort((have[2], have[1], ~have[0], have[3]), axis=-1)[:, : self.most]
        self.score[lists], self.id[lists], self.none[lists], self.free[lists] = (np.take_along_axis(x, order, 1) for x in have)

    def rows(self, anchors: np.ndarray, a_list: int) -> pa.RecordBatch:
        """What was kept; `a_list` lists belong to each anchor."""
        at, place = np.nonzero(~self.free)
        ids = pa.array(self.id[at, place], mask=self.none[at, place])
        return pa.RecordBatch.from_arrays([pa.array(anchors[at // a_list]), pa.array((at % a_list).astype(np.int32)), pa.array(self.score[at, place]), ids], names=["anchor", "positive", "score", "vec_id"])


class Chunk:
    """Rows in the order of their ids."""

    def __init__(self, batch: pa.RecordBatch):
        ids = batch.column(batch.schema.get_field_index("vec_id"))
        none = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(NO_ID).to_numpy()
        order = np.lexsort((none, ids))
        self.ids, self.none = ids[order], none[order]
        self.label = batch.column("label").to_numpy()[order]
        self.q = matrix(batch.column("q"))[order]


class Anchors:
    """A block of anchors, grouped by label."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("label")
        self.key, self.label, self.q = table.column("anchor").to_numpy(), table.column("label").to_numpy(), matrix(table.column("q"))
        self.ids = table.column("vec_id").combine_chunks()
        cuts = np.flatnonzero(np.concatenate([[True], self.label[1:] != self.label[:-1], [True]]))
        self.groups = list(zip(self.label[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()))

    def selves(self) -> pa.Table:
        """(anchor, anchor_id, own_score): the score of each anchor with itself."""
        own = np.concatenate([np.zeros(0, np.int64), *(products(x, x)[0] for x in self.q[:, None, :])])
        return pa.table({"anchor": self.key, "anchor_id": self.ids, "own_score": own})

    def limits(self, chosen: pa.Table) -> list[list[int]]:
        """The scores of each anchor's positives, in order."""
        out: list[list[int]] = [[] for _ in self.key]
        place = {k: i for i, k in enumerate(self.key.tolist())}
        for anchor, _, score in sorted(zip(*(chosen.column(k).to_pylist() for k in ("anchor", "positive", "score")))):
            out[place[anchor]].append(score)
        return out

    def parts(self, columns: np.ndarray, low: int, high: int) -> Iterator[np.ndarray]:
        """Anchors low to high in parts whose scores with so many columns fit."""
        step = max(1, SCORES // max(1, len(columns)))
        for i in range(low, high, step):
            yield np.arange(i, min(high, i + step))


def first_of_label(block, most_kept: int):
    """Rows of each anchor's label, the first by score and id in this task; the anchor is among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = block.value
        best = Best(len(anchors.key), most_kept)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Chunk(batch)
            for label, low, high in anchors.groups:
                columns = np.flatnonzero(rows.label == label)
                for part in anchors.parts(columns, low, high) if len(columns) else ():
                    score, at = sorted_scores(products(anchors.q[part], rows.q[columns]))
                    score, at = score[:, :most_kept], columns[at[:, :most_kept]]
                    best.offer(part, score, rows.ids[at], rows.none[at], np.zeros(at.shape, bool))
        yield best.rows(anchors.key, 1)

    return run


def first_below(block, limits, kept: int, lower: tuple[int, int]):
    """Rows of other labels, the first under each positive's score and not under the lower limit, in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, upper = block.value, limits.value  # of each anchor its positives' scores
        per = max(map(len, upper), default=0)
        best = Best(len(anchors.key) * per, kept)
        floor = [[-(-lower[0] * x // lower[1]) for x in own] for own in upper]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Chunk(batch)
            for label, low, high in anchors.groups:
                columns = np.flatnonzero(rows.label != label)
                for part in anchors.parts(columns, low, high) if len(columns) else ():
                    scores, at = sorted_scores(products(anchors.q[part], rows.q[columns]))
                    lists, first = [], []
                    for k, i in enumerate(part.tolist()):
                        start = np.searchsorted(~scores[k], ~np.array(upper[i], np.int64)).tolist()
                        for j, s in enumerate(start):
                            if s < len(columns) and scores[k, s] >= floor[i][j]:
                                lists.append(i * per + j)
                                first.append((k, s, floor[i][j]))
                    if not lists:
                        continue
                    k, s, limit = (np.array(x, np.int64)[:, None] for x in zip(*first))
                    s = s + np.arange(kept)
                    inside = np.minimum(s, len(columns) - 1)
                    score, where = scores[k, inside], columns[at[k, inside]]
                    best.offer(np.array(lists), score, rows.ids[where], rows.none[where], (s >= len(columns)) | (score < limit))
        yield best.rows(anchors.key, max(per, 1))

    return run


# --- the operator -----------------------------------------------------------------------------

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def by_score(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))


def hard_negatives(
    df: DataFrame, anchors: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 5,
    lower: tuple[int, int] = (80, 100), scale: int = SCALE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: a condition on vec_id; label: the label of a row; lower: the part of a positive's score that a negative
    must have at least.
    """
    spark = df.sparkSession
    rows = integer_rows(df, vec_id, vector, label, scale)
    own = S.materialise(rows.filter(anchors).withColumn("anchor", F.monotonically_increasing_id()))
    size = own.agg(F.sum(8 * F.size("q") + 24)).first()[0] or 0
    blocks = -(-size // block_bytes)
    done = []
    for k in range(blocks):
        table = own.filter(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == k).select("anchor", "vec_id", "label", "q")
        held = Anchors(table.toArrow())
        block = spark.sparkContext.broadcast(held)
        found = few_tasks(rows).mapInArrow(first_of_label(block, positives + 1), FOUND)
        alike = F.col("vec_id").eqNullSafe(F.col("anchor_id")) & (F.col("score") == F.col("own_score"))
        found = found.join(spark.createDataFrame(held.selves()), "anchor").withColumn("alike", alike)
        # one row that is the anchor or equal to it goes
        found = found.withColumn("nth", F.row_number().over(Window.partitionBy("anchor", "alike").orderBy("score"))).filter("not (alike and nth = 1)")
        found = S.materialise(found.withColumn("positive", F.row_number().over(by_score("anchor")) - 1).filter(F.col("positive") < positives))
        chosen = found.select("anchor", "positive", "score").toArrow()
        limits = spark.sparkContext.broadcast(held.limits(chosen))
        below = few_tasks(rows).mapInArrow(first_below(block, limits, negatives, lower), FOUND)
        below = below.withColumn("rank", F.row_number().over(by_score("anchor", "positive"))).filter(F.col("rank") <= negatives)
        below = below.select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        found = found.select("anchor", "positive", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        made = found.join(below, ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        done.append(S.materialise(made))
        block.unpersist()
        limits.unpersist()
    return reduce(DataFrame.unionAll, done) if done else spark.createDataFrame([], RESULT)
