"""Benchmark decontamination: suffix arrays over the training documents, searched for every test suffix.

How it scales. Each task builds word suffix arrays over shards of a few megabytes of its own documents and
binary-searches each for all suffixes of the benchmark, block by block: a block is at most `block_bytes` of
text, prepared on the driver one at a time and handed to the executors as a file, of which a worker holds one.
So memory is bounded by a block and a shard whatever the benchmark's size, a shard is sorted once for all
blocks, and no document is shuffled. Shards end at document ends, and a suffix stops there, so no match crosses
documents; a long document is a shard by itself.

Windows that several items share are one window with a list of items, so the places found in a shard are at
most its words times the number of different window lengths, however often a passage occurs on either side.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
Every word inside any occurrence of a window is hit. Word identity is by a 61-bit hash.

Every document gets the longest run of words that it has in common with an item: the suffixes of the block and
of the shard are one order, and each training suffix is compared with the two test suffixes next to it. Of
several runs of one length the first in the document counts, of several items with it the smallest item_id (as a string).

Null and empty texts have no words and are never contaminated; repeated rows are judged each for itself;
an empty benchmark leaves all clean; an empty table gives an empty result; an item_id that several rows
share counts once, and items without an id are one item with the empty name; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S

WINDOW = 13
BLOCK_BYTES = 8 << 20
CHUNK = 3 << 20
MOST_ITEMS = 1 << 18  # item names in a batch that goes back to Spark
RESULT = "doc_id long, n_words long, hits array<struct<s: int, e: int>>, items array<string>, longest int, longest_item string, longest_at int"


@dataclass
class Tests:
    """A block of the benchmark: all items' word hashes, their suffix array, and the different windows with their items."""

    hashes: np.ndarray
    item: np.ndarray  # of each word
    left: np.ndarray  # words from here to the item's end
    names: np.ndarray  # the different item ids, sorted
    array: "SuffixArray"
    ordered: np.ndarray  # the words in the order of their suffixes
    rank: np.ndarray  # place of each item's name, in the order of the array; behind its end a large one
    windows: np.ndarray  # a word at which each window begins
    sizes: np.ndarray
    owners: np.ndarray  # places of the names of the windows' items, one window behind the other
    first: np.ndarray  # where each window's begin

    @staticmethod
    def build(rows: list[tuple], window: int) -> "Tests":
        ids, texts = ["" if r[0] is None else str(r[0]) for r in rows], pa.array([r[1] or "" for r in rows], pa.string())
        data, offs = S.text_bytes(texts)
        hashes, first = hashed_words(data[offs[0] : offs[-1]], offs - offs[0])
        counts = np.diff(first)
        item = np.repeat(np.arange(len(ids)), counts)
        left = np.repeat(first[1:], counts) - np.arange(len(hashes))
        array = SuffixArray(hashes, first)
        owner = np.searchsorted(array.doc_start, array.order, "right") - 1
        names = sorted(set(ids))
        places = {name: i for i, name in enumerate(names)}
        name = np.array([places[i] for i in ids], np.int64)
        words = array.text[array.order] > 0
        starts = np.flatnonzero((left >= window) | (left == counts[item]))
        size = np.minimum(left[starts], window)
        low = array.bound(array.text, starts + item[starts], size, False)
        kinds, one, kind = np.unique(np.stack([low, size], 1), axis=0, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([kind.ravel(), name[item[starts]]], 1), axis=0)
        return Tests(
            hashes, item, left, np.array(names, object), array, (array.order - owner)[words], np.append(name[owner], len(names)),
            starts[one], size[one], pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(kinds) + 1)),
        )

    def first_names(self, words: np.ndarray, size: np.ndarray) -> list[str]:
        """The smallest name of an item that holds the `size` words which begin at each of `words`."""
        array, start = self.array, words + self.item[words]
        low, high = (array.bound(array.text, start, size, upper) for upper in (False, True))
        spans, back = np.unique(np.stack([low, high], 1), axis=0, return_inverse=True)
        least = np.minimum.reduceat(self.rank, spans.ravel())[::2]
        return self.names[least[back.ravel()]].tolist()

    def items_of(self, windows: np.ndarray) -> list[str]:
        """The items of some windows, sorted."""
        return self.names[np.unique(np.concatenate([self.owners[self.first[w] : self.first[w + 1]] for w in windows.tolist()]))].tolist()


def hashed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lower = S.ASCII_LOWER[data]
    starts, ends, first = S.words(lower, offs, S.WORD_BYTES)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return S.span_hash(S.prefix_hash(lower), starts, ends) | S.U64(1), first


class SuffixArray:
    """Word suffixes of one shard in order: by eight-byte keys of several words, then by prefix doubling.

    `text` holds the rank of each word in the shard's vocabulary from 1, and 0 at each document's end.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        counts = np.diff(first)
        self.vocab, ranks = np.unique(hashes, return_inverse=True)
        n = len(hashes) + len(counts)
        self.doc_start = first[:-1] + np.arange(len(counts))  # in text, one 0 after each document
        self.text = np.zeros(n + 64, np.int64)
        self.text[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = ranks + 1
        bits = max(1, int(len(self.vocab)).bit_length())
        take = max(1, 63 // bits)
        key = np.zeros(n, np.int64)
        for i in range(take):
            key = (key << bits) | self.text[i : i + n]
        self.order = np.argsort(key, kind="stable")
        sorted_key = key[self.order]
        depth = take
        new = np.ones(n, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.zeros(n + 64, np.int64)
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[self.order] = head[group] + 1  # suffixes that still tie have one rank
        size = np.diff(np.append(head, n))
        tied = np.flatnonzero(size[group] > 1)
        tied = tied[self.text[self.order[tied]] > 0]  # suffixes at document ends are all alike
        while len(tied) and depth < n:
            at = self.order[tied]
            beyond = rank[np.minimum(at + depth, n)]
            low = rank[at]
            again = np.lexsort((beyond, low))
            at, beyond, low = at[again], beyond[again], low[again]
            self.order[tied] = at
            new = np.ones(len(at), bool)
            new[1:] = (low[1:] != low[:-1]) | (beyond[1:] != beyond[:-1])
            head = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            rank[at] = tied[head[group]] + 1
            size = np.diff(np.append(head, len(at)))
            # equal up to a document's end: equal suffixes, no later words to compare
            ended = self.ended(at, depth * 2)
            tied = tied[(size[group] > 1) & ~ended]
            depth *= 2
        self.n = n

    def ended(self, at: np.ndarray, depth: int) -> np.ndarray:
        ends = self.doc_start[1:] - 1 if len(self.doc_start) > 1 else np.zeros(0, np.int64)
        ends = np.append(ends, len(self.text) - 65)
        return at + depth > ends[np.searchsorted(ends, at)]

    def bound(self, words: np.ndarray, start: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
        """Per test suffix, the first place in the order that is not below it (upper: that is above it)."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            right = self.below(words, start[open_], size[open_], self.order[mid], upper)
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        return low

    def below(self, words: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, upper: bool) -> np.ndarray:
        out = np.full(len(at), upper)
        same = np.arange(len(at))
        for i in range(int(size.max(initial=0))):
            same = same[size[same] > i]
            if not len(same):
                break
            x, y = self.text[at[same] + i], words[start[same] + i]
            out[same[x < y]] = True
            out[same[x > y]] = False
            same = same[x == y]
        return out

    def agree(self, words: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words in which test suffix and training suffix agree."""
        out = np.zeros(len(at), np.int64)
        same = np.arange(len(at))
        for i in range(int(size.max(initial=0))):
            same = same[size[same] > i]
            same = same[self.text[at[same] + i] == words[start[same] + i]]
            if not len(same):
                break
            out[same] += 1
        return out


def search(shard: SuffixArray, tests: Tests) -> tuple[np.ndarray, ...]:
    """(place, window) of each occurrence; for each place of the shard's text the words it has in common with a test suffix, and that suffix."""
    found = np.searchsorted(shard.vocab, tests.hashes)
    near = np.minimum(found, max(0, len(shard.vocab) - 1))
    known = shard.vocab[near] == tests.hashes if len(shard.vocab) else np.zeros(len(tests.hashes), bool)
    words = np.append(np.where(known, found + 1.0, found + 0.5), -1.0)  # other words lie between two ranks, so that the order stays that of the hashes
    windows = np.flatnonzero(known[tests.windows])
    starts, size = tests.windows[windows], tests.sizes[windows]
    low, high = (shard.bound(words, starts, size, upper) for upper in (False, True))
    times = high - low
    who = np.repeat(np.arange(len(starts)), times)
    places = shard.order[np.repeat(low, times) + np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)]
    # the longest match of a training suffix is with one of the two test suffixes around it in the common order
    best, mate = np.zeros(shard.n, np.int64), np.zeros(shard.n, np.int64)
    ordered = tests.ordered[known[tests.ordered]]
    if len(ordered):
        at = shard.bound(words, ordered, tests.left[ordered], False)
        live = np.flatnonzero(shard.text[shard.order] > 0)
        after = np.searchsorted(at, live, "right")
        for side in (after - 1, after):
            fits = (side >= 0) & (side < len(ordered))
            place, suffix = shard.order[live[fits]], ordered[side[fits]]
            length = shard.agree(words, suffix, tests.left[suffix], place)
            better = length > best[place]
            best[place[better]], mate[place[better]] = length[better], suffix[better]
    return places, windows[who], best, mate


_HELD: dict[str, Tests] = {}


def held(name: str) -> Tests:
    """A block from its file; a worker keeps the last one."""
    if name not in _HELD:
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            tests = pickle.load(f)
        _HELD.clear()
        _HELD[name] = tests
    return _HELD[name]


class Found:
    """What the blocks of a benchmark have in common with the documents of a shard."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.n_docs = len(first) - 1
        self.shard = SuffixArray(hashes, first) if len(hashes) else None
        self.marks = np.zeros(self.shard.n + 1 if self.shard else 1, np.int64)
        self.items: list[list[str]] = [[] for _ in range(self.n_docs)]
        self.longest: list[tuple] = [(0, None, None)] * self.n_docs  # words, place, item

    def add(self, block: Tests) -> None:
        shard = self.shard
        if shard is None or not len(block.hashes):
            return
        places, window, best, mate = search(shard, block)
        size = len(self.marks)
        self.marks += np.bincount(places, minlength=size) - np.bincount(places + block.sizes[window], minlength=size)
        doc = np.searchsorted(shard.doc_start, places, "right") - 1
        pairs = np.unique(doc * len(block.windows) + window)
        doc, window = np.divmod(pairs, max(1, len(block.windows)))
        known: dict[bytes, list[str]] = {}  # copies have the same windows
        cuts = np.flatnonzero(np.diff(doc, prepend=-1, append=self.n_docs))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = window[s:e].tobytes()
            if key not in known:
                known[key] = block.items_of(window[s:e])
            d = int(doc[s])
            self.items[d] = sorted({*self.items[d], *known[key]}) if self.items[d] else known[key]
        longest = np.maximum.reduceat(best, shard.doc_start)
        top = np.flatnonzero((best > 0) & (best == np.repeat(longest, np.diff(np.append(shard.doc_start, shard.n)))))
        owner, one = np.unique(np.searchsorted(shard.doc_start, top, "right") - 1, return_index=True)
        at = top[one]
        for d, p, name in zip(owner.tolist(), (at - shard.doc_start[owner]).tolist(), block.first_names(mate[at], best[at]) if len(at) else []):
            n, place, other = self.longest[d]
            if (-int(longest[d]), p, name) < (-n, p if place is None else place, name if other is None else other):
                self.longest[d] = (int(longest[d]), p, name)

    def hits(self) -> list[list[dict]]:
        """Word spans of each document."""
        out: list[list[dict]] = [[] for _ in range(self.n_docs)]
        if self.shard is not None:
            inside = np.cumsum(self.marks) > 0
            edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
            s, e = edges[::2], edges[1::2]
            doc = np.searchsorted(self.shard.doc_start, s, "right") - 1
            base = self.shard.doc_start[doc]
            for d, x, y in zip(doc.tolist(), (s - base).tolist(), (e - base).tolist()):
                out[d].append({"s": x, "e": y})
        return out


def judge(names: list[str], carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offs, rows in S.chunks(batches, CHUNK):
            hashes, first = hashed_words(data, offs)
            found = Found(hashes, first)
            for name in names:
                found.add(held(name))
            hits, total = found.hits(), np.cumsum([0, *map(len, found.items)])
            struct, at, n = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), 0, rows.num_rows
            while at < n:  # in batches of a bounded number of items, or one document
                to = min(n, max(at + 1, int(np.searchsorted(total, total[at] + MOST_ITEMS, "right")) - 1))
                longest, own = found.longest[at:to], rows.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(own.schema.get_field_index("doc_id")), pa.array(np.diff(first)[at:to]), pa.array(hits[at:to], struct), pa.array(found.items[at:to], pa.list_(pa.string())),
                        pa.array([x[0] for x in longest], pa.int32()), pa.array([x[2] for x in longest], pa.string()), pa.array([x[1] for x in longest], pa.int32()), *(own.column(c) for c in carry),
                    ],
                    names=["doc_id", "n_words", "hits", "items", "longest", "longest_item", "longest_at", *carry],
                )
                at = to

    return run


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's rows in runs of at most block_bytes (a longer item is a run by itself), one at a time on the driver."""
    held, size = [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).toLocalIterator():
        own = len((row[1] or "").encode())
        if held and size + own > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += own
    yield held


def sent(spark: SparkSession, tests: Tests) -> str:
    """The name under which the executors find the block; Spark's file server hands it out."""
    name = f"strataloom-tests-{uuid.uuid4().hex}"
    with open(os.path.join(tempfile.mkdtemp(prefix="spark-"), name), "wb") as f:
        pickle.dump(tests, f, protocol=5)
    spark.sparkContext.addFile(f.name)
    return name


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, item: str = "item_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, hits (word spans), items, contaminated, and the longest verbatim match with its item and place; then the columns to carry along."""
    carry = carry or []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text"))
    names = [sent(docs.sparkSession, Tests.build(block, window)) for block in blocks(benchmark, item, text, block_bytes)]
    schema = ", ".join([RESULT, *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)])
    out = rows.mapInArrow(judge(names, carry), schema)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]).cast("long"))
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "longest", "longest_item", "longest_at",
    )


def brute_force(docs: list[tuple], benchmark: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract in plain Python, for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    where: dict[tuple, set] = {}
    for i, t in benchmark:
        w = split(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            where.setdefault(tuple(w[s : s + window]), set()).add("" if i is None else str(i))
    sizes = {len(k) for k in where}
    out = []
    for i, t in docs:
        w = split(t)
        hit, items = [False] * len(w), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (own := where.get(tuple(w[s : s + n]))) is not None:
                    items |= own
                    hit[s : s + n] = [True] * n
        out.append((i, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out
