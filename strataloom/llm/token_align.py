"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another, and how often.

How it scales. A text is cut into segments (a run of letters, of digits or of other signs, with the space before it)
where neither tokenizer ever joins characters, and each distinct segment is encoded once a worker; equal hashes are
told apart by bytes. Three passes, none with a group that grows:

1. a map over the texts counts linked pairs as packed numbers `a << 32 | b`, `np.unique` with sums a partition;
2. the partial counts are written, range-partitioned, sorted and summed by run length: one sorted table;
3. its partitions are written as arrays to the shared folder; a second map over the texts memory-maps them and looks
   the counts up with searchsorted. A shared folder that is no file system is read shard by shard.

Cuts: before a single space or the first of several, behind a letter, digit or sign and with something after it; at
both sides of a line feed between two of these; where letters, digits and signs meet, but not behind an apostrophe
(contractions). Letters are those of ASCII and Latin-1. The first tokenizer's pattern always splits there; that no
piece of the second crosses such a place is checked when it is loaded (else whole documents are encoded).

Texts null or empty have no tokens, nor have texts that a tokenizer does not give back byte by byte (one with U+2581,
say): zeros and an empty string. Repeated rows count as often as they occur; a null doc_id stays null; an empty table
gives an empty result; further columns are ignored. A very long text is a chunk by itself.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S
from .packing import Words, appended, equal_spans

CHUNK = 1_900_000  # with a space before each document under 2^21, a size of the tables of powers
SLOTS = 1 << 19  # of a worker's table of segments: some 50 MB with what it refers to
MOST_KEYS = 1 << 21  # partial counts that are held before they are summed
SHIFT = 32
BEST = pa.list_(pa.struct([("b", pa.int64()), ("most", pa.int64())]))
#: The pattern of byte-level vocabularies (a fixed value), used where a file says that it splits so.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: 1 letter, 2 digit, 3 sign, 0 space and control characters, 4 anything else.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 3
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = 1
KIND[128:] = 4
PLAIN = re.compile(rb" ?(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def kinds(data: np.ndarray) -> np.ndarray:
    kind = KIND[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]  # the signs of multiplication and division
    kind[at] = kind[at + 1] = 1
    return kind


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair(Words):
    """Both tokenizers and the segments that a worker has met; one per worker and pair of files.

    `ids` holds a segment's ids of the first tokenizer, then those of the second; `keys` its links.
    """

    _pairs: dict[tuple[str, str], "Pair"] = {}

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = byte_of_symbol()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(back[c] for c in x) if all(c in back for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        own = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.splits = not any(crosses(p) for p in own)
        self.fast = rank_encoder(path_a, self.bytes_a)
        self.clear()

    @classmethod
    def of(cls, path_a: str, path_b: str) -> "Pair":
        if (path_a, path_b) not in cls._pairs:
            cls._pairs[path_a, path_b] = cls(path_a, path_b)
        return cls._pairs[path_a, path_b]

    def clear(self, words: int = 0) -> None:
        super().clear(words)
        self.slots = max(SLOTS, 1 << (2 * words).bit_length())
        self.keys, self.values = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.link_start, self.links, self.links_used = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int64), 0
        self.facts = np.zeros((3, 1 << 16), np.int32)  # ids of the first tokenizer, groups, given back byte by byte

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Enter segments; their numbers."""
        raw = [data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist())]
        simple = np.array([PLAIN.fullmatch(x) is not None for x in raw], bool) & self.splits
        parts = [np.flatnonzero(simple), np.flatnonzero(~simple)]
        done = self.together([raw[i] for i in parts[0]]) if len(parts[0]) else None
        if done is None:
            parts = [np.zeros(0, np.int64), np.arange(len(raw))]
            done = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
        order = np.concatenate(parts)
        a, n_a, b, n_b, good = (np.concatenate(x) for x in zip(done, self.singly([raw[i] for i in parts[1]])))
        raw = [raw[i] for i in order]
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.union1d(ends_a, ends_b)  # one token of each lies between two neighbours: a link
        of_a, of_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        segment = np.repeat(np.arange(len(raw)), n_a)[of_a]
        both = (ends_a[of_a] == cuts) & (ends_b[of_b] == cuts) if len(cuts) else np.zeros(0, bool)
        size = n_a + n_b
        ids = np.zeros(int(size.sum()), np.uint32)
        before = np.cumsum(size) - size
        ids[np.repeat(before - (np.cumsum(n_a) - n_a), n_a) + np.arange(len(a))] = a
        ids[np.repeat(before + n_a - (np.cumsum(n_b) - n_b), n_b) + np.arange(len(b))] = b
        n, links = self.n, np.bincount(segment, minlength=len(raw))
        self.start, self.ids, self.used = appended(self.start, n, self.ids, self.used, size, ids)
        keys = (a[of_a] << SHIFT) | b[of_b] if len(cuts) else np.zeros(0, np.int64)
        self.link_start, self.links, self.links_used = appended(self.link_start, n, self.links, self.links_used, links, keys)
        lengths = np.array([len(x) for x in raw], np.int64)
        self.bytes_start, self.bytes, self.bytes_used = appended(self.bytes_start, n, self.bytes, self.bytes_used, lengths, np.frombuffer(b"".join(raw), np.uint8))
        while n + len(raw) > self.facts.shape[1]:
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)], axis=1)
        self.facts[:, n : n + len(raw)] = [n_a, np.bincount(segment[both], minlength=len(raw)), good]
        self.n += len(raw)
        number = np.zeros(len(raw), np.int64)
        number[order] = np.arange(n, self.n)
        return number

    def together(self, raw: list[bytes]) -> tuple[np.ndarray, ...] | None:
        """(ids, ids a segment) of both tokenizers for plain segments, encoded as lines of one text; None if a token crosses lines."""
        text = b"\n" + b"\n".join(raw)
        lengths = np.array([len(x) for x in raw], np.int64)
        breaks = np.cumsum(lengths + 1) - (lengths + 1)
        out = []
        string = text.decode()
        ids_a = self.fast.encode_ordinary(string) if self.fast else self.a.encode(string, add_special_tokens=False).ids
        for ids, size, names, lead in ((ids_a, self.size_a, self.bytes_a, b""), (self.b.encode(string), self.size_b, self.bytes_b, b" ")):
            if b"".join([names[x] for x in ids]) != lead + text:
                return None
            ids = np.array(ids, np.int64)
            ends = np.cumsum(size[ids]) - len(lead)
            at = np.searchsorted(ends, breaks + 1)
            if (ends[at] != breaks + 1).any() or (size[ids[at]] != 1).any():
                return None
            keep = np.ones(len(ids), bool)
            keep[at] = False
            keep[: at[0]] = False
            out += [ids[keep], np.diff(np.append(at, len(ids))) - 1]
        return (*out, np.ones(len(raw), bool))

    def singly(self, raw: list[bytes]) -> tuple[np.ndarray, ...]:
        """The same for any segments; one that is not given back has no tokens."""
        texts = [x.decode("utf-8", "replace") for x in raw]
        ids_a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # behind a line feed, the second tokenizer puts no space of its own before a segment
        ids_b = [x[2:] for x in self.b.encode(["\n" + x for x in texts], num_threads=1)] if self.splits else self.b.encode([x[1:] for x in texts], num_threads=1)
        good = np.zeros(len(raw), bool)
        for i, want in enumerate(raw):
            good[i] = b"".join([self.bytes_a[x] for x in ids_a[i]]) == want == b"".join([self.bytes_b[x] for x in ids_b[i]])
            if not good[i]:
                ids_a[i], ids_b[i] = [], []
        flat = [np.fromiter((x for y in z for x in y), np.int64) for z in (ids_a, ids_b)]
        sizes = [np.array([len(x) for x in z], np.int64) for z in (ids_a, ids_b)]
        return flat[0], sizes[0], flat[1], sizes[1], good

    def written(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The groups of segments as text, one behind the other, each with a closing semicolon; and where each begins."""
        size, n_a = self.start[numbers + 1] - self.start[numbers], self.facts[0, numbers].astype(np.int64)
        owner = np.repeat(np.arange(len(numbers)), size)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        ids = self.ids[self.start[numbers][owner] + inner].astype(np.int64)
        from_b = inner >= n_a[owner]
        length = np.where(from_b, self.size_b[np.minimum(ids, len(self.size_b) - 1)], self.size_a[np.minimum(ids, len(self.size_a) - 1)])
        pa_, pb_ = np.flatnonzero(~from_b), np.flatnonzero(from_b)
        ends_a, ends_b = np.cumsum(length[pa_]), np.cumsum(length[pb_])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        place = np.zeros(len(ids), np.int64)  # in the text's order: group by group, the first tokenizer's ids before the second's
        place[pa_] = np.arange(len(pa_)) + np.searchsorted(group_b, group_a)
        place[pb_] = np.arange(len(pb_)) + np.searchsorted(group_a, group_b, "right")
        closing = np.full(len(ids), ord(","), np.uint8)
        closing[pa_[np.isin(ends_a, shared, assume_unique=True)]] = ord("|")
        closing[pb_[np.isin(ends_b, shared, assume_unique=True)]] = ord(";")
        order = np.empty(len(ids), np.int64)
        order[place] = np.arange(len(ids))
        ids, closing, owner = ids[order], closing[order], owner[order]
        digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 7))
        last = np.cumsum(digits + 1) - 1
        text = np.zeros(int(last[-1]) + 1 if len(last) else 0, np.uint8)
        text[last] = closing
        for k in range(7):
            has = digits > k
            text[last[has] - 1 - k] = ord("0") + (ids[has] // 10**k) % 10
        ends = np.concatenate([[0], last + 1])
        return text.tobytes(), ends[np.searchsorted(owner, np.arange(len(numbers) + 1))]


def crosses(piece: str) -> bool:
    """Whether a piece has characters on both sides of a place where texts are cut."""
    body = piece.lstrip("▁")
    raw = np.frombuffer(body.encode(), np.uint8)
    if not len(raw):
        return False
    kind = kinds(raw)
    meet = (kind[1:] != kind[:-1]) & np.isin(kind[1:], (1, 2, 3)) & np.isin(kind[:-1], (1, 2, 3))
    return "▁" in body or ("\n" in body and len(body) > 1) or bool(meet.any())


def rank_encoder(path: str, names: list[bytes]):
    """A faster encoder of plain text with the same result, if the file is of the usual byte-level kind."""
    import tiktoken

    with open(path, encoding="utf-8") as source:
        spec = json.load(source)
    split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    pairs = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", ())]
    vocab = model.get("vocab", {})
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    if not usual or any(vocab.get(m.replace(" ", "")) != 256 + i for i, m in enumerate(pairs)):
        return None
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={names[i]: i for i in range(256 + len(pairs))}, special_tokens={})


def segments(data: np.ndarray, offs: np.ndarray, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the segments; every document begins with the space that the encoders put before it."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    if cut and n > 2:
        kind = kinds(data)
        firm = (kind > 0) & (kind < 4)
        before, here = kind[:-1], kind[1:]
        edge[1:-1] = firm[:-1] & firm[1:] & (before != here) & (data[:-1] != 39)
        edge[1:-2] |= firm[:-2] & (data[1:-1] == 32)
        line = np.flatnonzero(firm[:-2] & (data[1:-1] == 10) & firm[2:]) + 1
        edge[line] = edge[line + 1] = True
        edge[offs[1:] - 1] &= data[offs[1:] - 1] != 32  # nothing follows
        edge[offs[:-1] + 1] &= data[offs[:-1]] != 32
    edge[offs] = True
    cuts = np.flatnonzero(edge)
    return cuts[:-1], cuts[1:], np.searchsorted(offs, cuts[:-1], "right") - 1


def known(data: np.ndarray, offs: np.ndarray, pair: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each segment, its document, which documents have tokens: not empty and given back byte by byte)."""
    n = len(offs) - 1
    data = np.insert(data, offs[:-1], 32)
    faithful = np.diff(offs) > 0
    offs = offs + np.arange(n + 1)
    start, end, doc = segments(data, offs, pair.splits)
    names, at, back = np.unique(S.span_hash(S.prefix_hash(data), start, end), return_index=True, return_inverse=True)
    number = pair.places(names, data, start[at], end[at])[back]
    odd = np.flatnonzero(~equal_spans(data, start, end, data, start[at[back]], end[at[back]]))
    if len(odd):  # segments that share the hash of another one
        number[odd] = pair.encode(data, start[odd], end[odd])
    faithful[doc[pair.facts[2, number] == 0]] = False
    return number, doc, faithful


def links_of(pair: Pair, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair keys of some segments, one behind the other, and where each segment's begin."""
    low, size = pair.link_start[numbers], pair.link_start[numbers + 1] - pair.link_start[numbers]
    before = np.concatenate([[0], np.cumsum(size)])
    return pair.links[np.repeat(low - before[:-1], size) + np.arange(before[-1])], before


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    names, back = np.unique(keys, return_inverse=True)
    order = np.argsort(back, kind="stable")
    return names, np.add.reduceat(counts[order], np.searchsorted(back[order], np.arange(len(names))))


def partial_counts(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(path_a, path_b)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for data, offs, _ in S.chunks(batches, CHUNK):
            number, doc, faithful = known(data, offs, pair)
            segment, times = np.unique(number[faithful[doc]], return_counts=True)
            keys, before = links_of(pair, segment)
            held.append(summed(keys, np.repeat(times.astype(np.int64), np.diff(before))))
            size += len(held[-1][0])
            if size > MOST_KEYS:
                held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > MOST_KEYS // 2:  # many different pairs: hand them on
                    yield _counts(*held.pop())
                    size = 0
        if held:
            yield _counts(*summed(*(np.concatenate(x) for x in zip(*held))))

    return run


def _counts(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])


def run_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, n): one row a key. The last key of a batch waits for the next."""
    last: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last:
            keys, counts = np.concatenate([last[0], keys]), np.concatenate([last[1], counts])
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        last = keys[-1:], counts[-1:]
        yield _counts(keys[:-1], counts[:-1])
    if last:
        yield _counts(*last)


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(key, n): how many links of the whole table hold each id pair; a = key >> 32, b = the low half. Partitions are ranges of keys, in order."""
    part = S.materialise(S.plain(docs).select("text").mapInArrow(partial_counts(path_a, path_b), "key long, n long"))
    return part.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run_sums, "key long, n long")


# --- shards -----------------------------------------------------------------------------------


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def shard_writer(folder: str, most: int = 1 << 20):
    """Sorted (key, n) rows as shards of at most about `most` keys: two int64 arrays behind one another in a file.

    A row for each file, with the highest count of each id of the second tokenizer in it. Only files of tasks that
    succeeded are named in the result, so an attempt that was lost leaves nothing in use.
    """

    def filed(held: list[pa.RecordBatch], store: fs.FileSystem, top: str) -> pa.RecordBatch:
        keys, counts = (np.concatenate([x.column(k).to_numpy() for x in held]).astype("<i8") for k in (0, 1))
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{top}/{name}") as out:
            out.write(keys.tobytes())
            out.write(counts.tobytes())
        low = keys & ((1 << SHIFT) - 1)
        order = np.lexsort((counts, low))
        last = np.flatnonzero(np.concatenate([low[order][1:] != low[order][:-1], [True]]))
        best = pa.array([[{"b": int(b), "most": int(n)} for b, n in zip(low[order][last], counts[order][last])]], BEST)
        return pa.RecordBatch.from_arrays([pa.array([int(keys[0])]), pa.array([name]), pa.array([len(keys)]), best], names=["low", "name", "n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= most:
                yield filed(held, store, top)
                held = []
        if held:
            yield filed(held, store, top)

    return run


class Shards:
    """Counts by key. Where the shared folder is a file system the shards are memory-mapped, else read one at a time."""

    _held: "Shards | None" = None

    def __init__(self, folder: str, index: list[tuple[int, str, int]]):
        self.folder, self.index = folder, index
        self.low = np.array([x[0] for x in index], np.int64)
        self.store, self.top = opened(folder)
        self.maps: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, folder: str, index: list[tuple[int, str, int]]) -> "Shards":
        if cls._held is None or cls._held.folder != folder:
            cls._held = cls(folder, index)
        return cls._held

    def shard(self, k: int) -> np.ndarray:
        name, n = self.index[k][1:]
        if not isinstance(self.store, fs.LocalFileSystem):
            with self.store.open_input_stream(f"{self.top}/{name}") as source:
                return np.frombuffer(source.read(), "<i8").reshape(2, n)
        if k not in self.maps:
            self.maps[k] = np.memmap(f"{self.top}/{name}", "<i8", "r", shape=(2, n))
        return self.maps[k]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted keys, all of which are there."""
        out = np.zeros(len(keys), np.int64)
        where = np.searchsorted(self.low, keys, "right") - 1
        edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(keys) else []
        for s, e in zip(edges[:-1], edges[1:]):
            names, values = self.shard(int(where[s]))
            out[s:e] = values[np.searchsorted(names, keys[s:e])]
        return out


def write_shards(counts: DataFrame) -> tuple[str, list[tuple[int, str, int]], np.ndarray]:
    """(folder, [(least key, file, keys)], highest count of each id of the second tokenizer). counts is sorted within ranges.

    The driver gets a row for each file, some million keys, and one for each id of the second vocabulary.
    """
    spark = counts.sparkSession
    folder = f"{S.own_dir(spark)}/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    rows = S.materialise(counts.mapInArrow(shard_writer(folder), "low long, name string, n long, best array<struct<b: long, most: long>>"))
    most = rows.select(F.inline("best")).groupBy("b").agg(F.max("most").alias("most")).collect()
    best = np.zeros(max([0, *(r["b"] for r in most)]) + 1, np.int64)
    best[[r["b"] for r in most]] = [r["most"] for r in most]
    return folder, sorted(map(tuple, rows.select("low", "name", "n").collect())), best


# --- the operator -----------------------------------------------------------------------------

FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def aligned(path_a: str, path_b: str, folder: str, index: list[tuple[int, str, int]], best: np.ndarray, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, shards = Pair.of(path_a, path_b), Shards.of(folder, index)
        for data, offs, rows in S.chunks(batches, CHUNK):
            number, doc, faithful = known(data, offs, pair)
            n, use = len(offs) - 1, faithful[doc]
            number, doc = number[use], doc[use]
            segment, back = np.unique(number, return_inverse=True)
            keys, before = links_of(pair, segment)
            names, where = np.unique(keys, return_inverse=True)
            count = shards.counts(names)
            top = count == best[names & ((1 << SHIFT) - 1)]
            of = np.repeat(np.arange(len(segment)), np.diff(before))
            sides = [pair.facts[0, segment].astype(np.int64), (pair.start[segment + 1] - pair.start[segment]) - pair.facts[0, segment], pair.facts[1, segment].astype(np.int64), np.diff(before)]
            for values in (top.astype(np.int64), count):
                total = np.zeros(len(segment), np.int64)
                np.add.at(total, of, values[where])
                sides.append(total)
            sums = np.zeros((len(FIELDS), n), np.int64)
            for k, values in enumerate(sides):
                np.add.at(sums[k], doc, values[back])
            raw, cuts = pair.written(segment)
            text = [raw[s:e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            first = np.searchsorted(doc, np.arange(n + 1)).tolist()
            digest, whole = [], []
            for s, e in zip(first[:-1], first[1:]):
                own = b"".join([text[k] for k in back[s:e].tolist()])[:-1]
                digest.append(hashlib.sha256(own).hexdigest() if own else "")
                if with_groups:
                    whole.append(own.decode())
            columns = [rows.column("doc_id"), *(pa.array(x) for x in sums), pa.array(digest, pa.string())]
            if with_groups:
                columns.append(pa.array(whole, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *FIELDS, "groups_sha256", *["groups"] * with_groups])

    return run


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = True) -> DataFrame:
    """One row a document: tokens of each tokenizer, groups (`a1,a2|b1;a3|b2`) and their digest, links and their counts.

    A link is a token of each tokenizer with a byte in common; its count is how many links of the table hold this id
    pair; n_best are the links whose count is the highest of their id of the second tokenizer.
    """
    folder, index, best = write_shards(pair_counts(docs, path_a, path_b))
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in FIELDS) + ", groups_sha256 string" + ", groups string" * with_groups
    return S.plain(docs).mapInArrow(aligned(path_a, path_b, folder, index, best, with_groups), schema)
