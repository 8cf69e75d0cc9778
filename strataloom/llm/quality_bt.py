"""Quality scores by Bradley-Terry ranking: logistic loss on feature differences of preference pairs.

Two kinds of features: measures of a text's form (FEATURES), and its words, pairs of words and byte 4-grams, hashed
into BUCKETS shares of the text. The weights of the latter come first, from the same pairwise loss, on at most
`most_lexical` labelled rows; a text's weighted sum of them is one more feature beside the measures. So that this sum
is not overrated, the rows it was learned from are split in two halves and scored by the weights of the other half.

The model is fitted on the driver from at most `most_labels` labelled rows (a hashed sample, so the bound
holds at any size); of these, each low document is paired with `pairs_each` high ones. Scoring is one map over
the texts without a shuffle. The score is the logistic of the distance to a threshold, which is a quantile of
the fitted rows' raw scores: the lowest level, of a fixed grid, that separates the two labels about as well as the best. It maps to 0.3.

Scores use the text alone: labels, lang, source and doc_id are no inputs. Null and empty texts have the
features of no words; repeated rows get the same score; with no usable labels (none, or one kind only) every
score is 0.5; a document with both labels is not learned from, and of several texts of a doc_id the one with the
smallest features is; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

MOST_LABELS, MOST_LEXICAL, PAIRS_EACH, ACCEPT = 20_000, 2_000, 8, 0.3
BITS = 13
BUCKETS = 3 << BITS  # words, pairs of words, byte 4-grams
STEPS, RATE = 40, 0.5  # of the lexical weights
SLACK = 0.001  # of the balanced share of right labels, for the choice of the threshold
CHUNK = 1 << 19  # a worker holds some 130 bytes for each byte of a chunk
WINDOW = 20
FEATURES = [
    "log_words", "word_bytes", "long_words", "upper_words", "marked_words", "bare_marks", "symbols", "digits", "wide", "distinct", "repeated_lines", "short_words", "stutter",
    "most_upper", "most_marked", "most_bare", "most_symbols", "most_long", "most_stutter",
]
_is = lambda chars: np.isin(np.arange(256), list(chars.encode()))
UPPER, LOWER, DIGIT, MARK = _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _is("abcdefghijklmnopqrstuvwxyz"), _is("0123456789"), _is("#*$%&|<>!^~=_@\\{}[]+")


def _per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _most(flags: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Largest share of flags in `width` consecutive words of each document (all words of a shorter one)."""
    n = len(flags)
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])
    counts = np.diff(first)
    out = np.divide(total[first[1:]] - total[first[:-1]], counts, out=np.zeros(len(counts)), where=counts > 0)
    long = np.flatnonzero(counts >= width)
    if len(long) and n >= width:
        share = (total[width:] - total[:-width]) / width
        bounds = np.stack([first[:-1][long], first[1:][long] - width + 1], 1).ravel()
        out[long] = np.maximum.reduceat(np.append(share, 0), bounds)[::2]
    return out


class Lexical:
    """Weights of hashed words, pairs of words and byte 4-grams; a text's score is the mean weight of each kind, added."""

    def __init__(self, weights: np.ndarray):
        self.weights = np.append(weights, 0.0)  # the last is of what crosses from one document to the next

    def scores(self, kinds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        doc = lambda first: np.repeat(np.arange(len(first) - 1), np.diff(first))
        # added up document by document, so that a score does not depend on the texts that are read with it
        return sum(np.bincount(doc(first), self.weights[bucket], len(first) - 1) / np.maximum(1, np.diff(first)) for bucket, first in kinds)


def lexical_buckets(data: np.ndarray, offs: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, where each document's begin) of the words, the pairs that begin at each word and the 4-grams that begin at each byte."""
    top = S.U64(64 - BITS)
    words = (hashes >> top).astype(np.int64)
    pairs = np.full(len(hashes), BUCKETS, np.int64)
    if len(hashes) > 1:
        pairs[:-1] = (S.mix(hashes[:-1] * S.U64(0xA0761D6478BD642F) + hashes[1:]) >> top).astype(np.int64) + (1 << BITS)
        last = first[1:][np.diff(first) > 0] - 1
        pairs[last] = BUCKETS
    grams = np.full(len(data), BUCKETS, np.int64)
    if len(data) > 3:
        low = S.ASCII_LOWER[data].astype(np.uint32)
        code = low[:-3] | (low[1:-2] << 8) | (low[2:-1] << 16) | (low[3:] << 24)
        grams[:-3] = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) + (2 << BITS)
        for back in range(1, 4):  # those that would reach into the next document
            at = offs[1:] - back
            grams[at[at >= offs[:-1]]] = BUCKETS
    return [(words, first), (pairs, first), (grams, offs)]


def shares(kinds: list[tuple[np.ndarray, np.ndarray]], n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's buckets and its share of each, as flat lists with their bounds."""
    keys, values = [], []
    for bucket, first in kinds:
        doc = np.repeat(np.arange(n_docs), np.diff(first))
        inside = bucket < BUCKETS
        key, count = np.unique(doc[inside] * BUCKETS + bucket[inside], return_counts=True)
        keys.append(key)
        values.append(count / np.maximum(1, np.diff(first))[key // BUCKETS])
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    return key % BUCKETS, value.astype(np.float32), np.searchsorted(key, np.arange(n_docs + 1) * BUCKETS)


def lexical_weights(bucket: np.ndarray, share: np.ndarray, bounds: np.ndarray, label: np.ndarray, pairs_each: int) -> np.ndarray:
    """Weights by gradient steps (Adagrad) on the Bradley-Terry loss of document pairs."""
    weights, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-12)
    low, high = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
    if not len(low) or not len(high):
        return weights
    rng = np.random.Generator(np.random.PCG64(5))
    worse = np.repeat(low, pairs_each)
    better = high[rng.integers(0, len(high), len(worse))]
    sizes, n = np.diff(bounds), len(label)
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    for _ in range(STEPS):
        score = np.bincount(doc, share * weights[bucket], minlength=n)
        p = 1 / (1 + np.exp(np.clip(score[better] - score[worse], -30, 30)))
        push = (np.bincount(worse, p, minlength=n) - np.bincount(better, p, minlength=n)) / len(worse)
        gradient = np.bincount(bucket, share * push[doc], minlength=BUCKETS) + 1e-7 * weights
        seen += gradient**2
        weights -= RATE * gradient / np.sqrt(seen)
    return weights


def features(data: np.ndarray, offs: np.ndarray, lexical: list[Lexical] | None = None, which: np.ndarray | None = None) -> np.ndarray:
    """One row a document: FEATURES, and with lexical weights their sum; `which` names the weights for each document (-1: their mean)."""
    starts, ends, first = S.words(data, offs, S.NOT_SPACE)
    counts = np.diff(first).astype(np.float64)
    size = np.diff(offs).astype(np.float64)
    words, chars = np.maximum(counts, 1), np.maximum(size, 1)
    before = lambda member: np.concatenate([[0], np.cumsum(member[data], dtype=np.int64)])
    within = lambda t: t[ends] - t[starts]
    over = lambda t: (t[offs[1:]] - t[offs[:-1]]) / chars
    upper, lower, mark, digit = before(UPPER), before(LOWER), before(MARK), before(DIGIT)
    wide = np.concatenate([[0], np.cumsum(data >= 128, dtype=np.int64)])
    length = ends - starts
    marks = within(mark)
    shout = (within(upper) >= 2) & (within(lower) == 0)
    marked = marks >= 2
    bare = (marks == length) & (length <= 2) & (length > 0)
    long = length >= 12
    per = lambda flags: _per_doc(flags, first) / words
    hashes = S.span_hash(S.prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(counts)), np.diff(first))
    stutter = np.zeros(len(doc), bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=len(counts)) / words
    lines = repeated_lines(data, offs)
    more = []
    if lexical:
        kinds = lexical_buckets(data, offs, hashes, first)
        if which is None:
            more.append(Lexical(np.mean([x.weights[:-1] for x in lexical], 0)).scores(kinds))
        else:
            own = np.stack([x.scores(kinds) for x in lexical])
            more.append(np.where(which < 0, own.mean(0), own[np.maximum(which, 0), np.arange(len(which))]))
    return np.stack(
        [
            np.log1p(counts), np.log1p(_per_doc(length, first) / words), per(long), per(shout), per(marked), per(bare), over(mark), over(digit), over(wide), distinct,
            lines, per(length <= 3), per(stutter), *(_most(f, first, WINDOW) for f in (shout, marked, bare, marks > 0, long, stutter)), *more,
        ],
        1,
    )


def repeated_lines(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Share of non-empty lines that equal an earlier one."""
    member = np.ones(256, bool)
    member[10] = False
    starts, ends, first = S.words(data, offs, member)
    if not len(starts):
        return np.zeros(len(offs) - 1)
    hashes = S.span_hash(S.prefix_hash(data), starts, ends)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    same = np.zeros(len(order))
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order], same, minlength=len(offs) - 1) / np.maximum(np.diff(first), 1)


class Model:
    """Weights of the standardised features, and the threshold."""

    def __init__(self, x: np.ndarray, label: np.ndarray, pairs_each: int, rate: float = 1e-3, lexical: list[Lexical] | None = None):
        self.lexical = [Lexical(np.mean([y.weights[:-1] for y in lexical], 0))] if lexical else None
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.weights, self.threshold, self.slope = np.zeros(x.shape[1]), None, 1.0
        z = self.standard(x)
        low, high = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
        if not len(low) or not len(high):
            return
        rng = np.random.Generator(np.random.PCG64(11))
        worse = np.repeat(low, pairs_each)
        better = high[rng.integers(0, len(high), len(worse))]
        d = z[better] - z[worse]
        w = np.zeros(d.shape[1])
        for _ in range(40):  # Newton steps on the convex Bradley-Terry loss with a small ridge
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient = -(d * p[:, None]).mean(0) + rate * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + rate * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-7:
                break
        self.weights = w
        raw = z @ w
        share = len(low) / len(label)
        levels = np.unique(np.clip(share * np.linspace(0.5, 1.5, 101), 0.0005, 0.9995))
        cuts = np.quantile(raw, levels)
        right = [((raw[high] >= c).mean() + (raw[low] < c).mean()) / 2 for c in cuts]
        # of the levels that separate about equally well the lowest: rather keep a good document than drop one
        self.threshold = float(cuts[np.array(right) >= max(right) - SLACK].min())
        self.slope = 2.0 / (raw.std() + 1e-9)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.threshold is None:
            return np.full(len(x), 0.5)
        at = self.slope * (self.standard(x) @ self.weights - self.threshold)
        return 1 / (1 + np.exp(-np.clip(at + np.log(ACCEPT / (1 - ACCEPT)), -30, 30)))


def lexical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for data, offs, rows in S.chunks(batches, CHUNK):
        starts, ends, first = S.words(data, offs, S.NOT_SPACE)
        hashes = S.span_hash(S.prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        bucket, share, bounds = shares(lexical_buckets(data, offs, hashes, first), rows.num_rows)
        lists = (pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)) for x in (bucket.astype(np.int32), share))
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "label", "half")), *lists], names=["doc_id", "label", "half", "bucket", "share"])


def feature_rows(lexical: list[Lexical]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offs, rows in S.chunks(batches, CHUNK):
            half = rows.column("half").to_numpy()
            x = features(data, offs, lexical, np.where(half < 0, -1, 1 - half))  # by the weights of the other half
            cuts = pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.ListArray.from_arrays(cuts, pa.array(x.ravel()))], names=["doc_id", "label", "x"])

    return run


def scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offs, rows in S.chunks(batches, CHUNK):
            x = features(data, offs, model.lexical)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rows.schema.names), pa.array(model.scores(x))], names=[*rows.schema.names, "score"])

    return run


def held_out(key: str = "doc_id"):
    """Rows that are never learned from."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, pairs_each: int = PAIRS_EACH, most_lexical: int = MOST_LEXICAL) -> Model:
    """Fit from labels (doc_id, quality) of rows that are not held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("doc_id", "label")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = usable.orderBy(*order).limit(most_labels)
    # half: 0 or 1 of the rows that the lexical weights are learned from, -1 of the others
    first = sample.orderBy(*order).limit(most_lexical).select("doc_id", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int").alias("half"))
    sample = S.materialise(sample.join(F.broadcast(first), "doc_id", "left").withColumn("half", F.coalesce("half", F.lit(-1))))
    rows = S.materialise(S.plain(docs).join(F.broadcast(sample), "doc_id"))
    got = rows.filter("half >= 0").mapInArrow(lexical_rows, "doc_id long, label int, half int, bucket array<int>, share array<float>")
    got = got.groupBy("doc_id", "label", "half").agg(F.min(F.struct("bucket", "share")).alias("l")).orderBy("doc_id").select("label", "half", "l.*").toArrow().combine_chunks()
    lexical = [_half(got, h, pairs_each) for h in (0, 1)]
    del got
    S.release()
    got = rows.mapInArrow(feature_rows(lexical), "doc_id long, label int, x array<double>").groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id").toArrow().combine_chunks()  # a row a label, so most_labels at most
    width = len(FEATURES) + 1
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width) if got.num_rows else np.zeros((1, width))
    label = got.column("label").to_numpy() if got.num_rows else np.ones(1)
    return Model(x, label, pairs_each, lexical=lexical)


def _half(got: pa.Table, half: int, pairs_each: int) -> Lexical:
    own = got.filter(pa.array(got.column("half").to_numpy() == half)).combine_chunks()
    if not own.num_rows:
        return Lexical(np.zeros(BUCKETS))
    bucket, share = (own.column(c).combine_chunks() for c in ("bucket", "share"))
    bounds = np.append(0, np.cumsum(pa.compute.list_value_length(bucket).to_numpy())).astype(np.int64)
    return Lexical(lexical_weights(bucket.flatten().to_numpy(), share.flatten().to_numpy(), bounds, own.column("label").to_numpy(), pairs_each))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, with score and predicted."""
    keep = docs.withColumn("text", F.col("text").cast("string")).drop("score", "predicted")
    out = keep.mapInArrow(scored(model), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields) + ", score double")
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, pairs_each: int = PAIRS_EACH) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    model = fit(docs, labels, most_labels, pairs_each)
    return score(S.plain(docs), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
