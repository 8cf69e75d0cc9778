"""Packing by power-of-two decomposition: pieces of binary lengths, bucketed by length.

A document of L tokens becomes floor(L / longest) pieces of the longest length and one piece for each
further bit of L, largest first. A piece is a sequence by itself, so no sequence crosses documents and none
is padded; equal lengths form a bucket (`bucket`, and write_buckets() files them so that a training batch
reads one length). There is no shuffle.

Tokens come from a public tokenizer file whose path is a parameter. The file's splitter never joins
characters across white space, so each distinct word is encoded once a worker and looked up afterwards;
words of ASCII and Latin-1 letters are also split where letters, digits and other characters meet, as the
splitter does. Words with an apostrophe, a `<` (special tokens) or other characters go to it whole and as
they are. New parts of split words are encoded by hundreds in one call, without the file's normalizer and
splitter, which would give them back unchanged; files with others than the known ones are not used so.

Null and empty texts are one end token; repeated rows are packed each for itself; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

LONGEST, END = 2048, 1
CHUNK = 1 << 19
SLOTS = 1 << 21  # of a worker's word table, some 60 MB
TOGETHER = 500  # plain words that are encoded as one text
#: 0 white space, 1 letter, 2 digit, 3 other; words with a byte of WHOLE, letters of Latin-1 apart, go to the tokenizer whole.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[65:91] = KIND[97:123] = 1
KIND[48:58] = 2
WHOLE = np.zeros(256, bool)
WHOLE[128:] = WHOLE[[0x27, 0x3C]] = True
#: Fixed: what NORMALIZER and SPLITTER give back as it is, in one piece.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:;=-@[-`{-~]+")
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PARTS = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
SPLITTER = {"type": "Split", "pattern": PARTS, "behavior": "Removed", "invert": True}


class Words:
    """Token ids of words by hash, in flat arrays of bounded size; one per worker and tokenizer file.

    The words' bytes are kept too and compared at each look-up, so a collision of hashes changes no result.
    """

    _all: dict[str, "Words"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain, self.closes = plain_tokenizer(self.tokenizer)
        self.clear()

    @classmethod
    def of(cls, path: str) -> "Words":
        if path not in cls._all:
            cls._all[path] = cls(path)
        return cls._all[path]

    def clear(self, words: int = 0) -> None:
        self.slots = max(SLOTS, 1 << (2 * words).bit_length())  # more only for a text with more distinct words
        self.keys, self.values = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.start, self.ids, self.used, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0, 0
        self.bytes_start, self.bytes, self.bytes_used = np.zeros(1 << 16, np.int64), np.zeros(1 << 19, np.uint8), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known words, -1 for others, by linear probing for all at once."""
        out, slot, open_ = np.full(len(hashes), -1, np.int64), self.home(hashes), np.arange(len(hashes))
        while len(open_):
            at = slot[open_]
            held = self.keys[at]
            hit = held == hashes[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (held != 0)]
            slot[open_] = (slot[open_] + 1) % self.slots
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Enter new, distinct hashes with their words' numbers."""
        slot, open_ = self.home(hashes), np.arange(len(hashes))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            self.keys[slot[free]] = hashes[free]
            won = np.zeros(len(hashes), bool)
            won[free] = self.keys[slot[free]] == hashes[free]
            self.values[slot[won]] = numbers[won]
            open_ = open_[~won[open_]]
            slot[open_] = (slot[open_] + 1) % self.slots

    def home(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> S.U64(17)) % S.U64(self.slots)).astype(np.int64)

    def places(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word, a span of data; no two have one hash."""
        hashes = np.where(hashes == 0, S.U64(1), hashes)
        if self.n + len(hashes) > self.slots * 5 // 8:
            self.clear(len(hashes))
        found = self.find(hashes)
        known = np.flatnonzero(found >= 0)
        own = found[known]
        same = equal_spans(data, start[known], end[known], self.bytes, self.bytes_start[own], self.bytes_start[own + 1])
        other = known[~same]  # another word has this hash: encoded anew, and not entered under it
        found[other] = -2
        missing = np.flatnonzero(found < 0)
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            fresh = found[part] == -1
            found[part] = self.encode(data, start[part], end[part])
            self.add(hashes[part[fresh]], found[part[fresh]])
        return found

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Append the words' ids and bytes; their numbers."""
        text = data.tobytes()
        raw = [text[s:e] for s, e in zip(start.tolist(), end.tolist())]
        plain = np.fromiter((PLAIN.fullmatch(x) is not None for x in raw), bool, len(raw)) & (self.plain is not None)
        order, n_plain, n = np.argsort(~plain, kind="stable"), int(plain.sum()), self.n
        raw = [raw[i] for i in order.tolist()]
        texts = [x.decode("utf-8", "replace") for x in raw]
        ids, sizes = (np.concatenate(x) for x in zip(self.together(texts[:n_plain]), self.singly(texts[n_plain:])))
        self.start, self.ids, self.used = appended(self.start, n, self.ids, self.used, sizes, ids)
        self.bytes_start, self.bytes, self.bytes_used = appended(self.bytes_start, n, self.bytes, self.bytes_used, (end - start)[order], np.frombuffer(b"".join(raw), np.uint8))
        self.n += len(raw)
        out = np.empty(len(raw), np.int64)
        out[order] = np.arange(n, self.n)
        return out

    def together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids a word) of plain words; the last id of each closes it, and no other (else they are encoded singly)."""
        runs = [texts[i : i + TOGETHER] for i in range(0, len(texts), TOGETHER)]
        own = [np.array(x.ids, np.uint32) for x in self.plain.encode_batch_fast(runs, is_pretokenized=True, add_special_tokens=False)] if runs else []
        ids = np.concatenate([np.zeros(0, np.uint32), *own])
        last = np.flatnonzero(self.closes[ids]) if runs else np.zeros(0, np.int64)
        return (ids, np.diff(last, prepend=-1)) if len(last) == len(texts) else self.singly(texts)

    def singly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words."""
        own = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in own], np.int64)
        return np.fromiter((y for x in own for y in x), np.uint32, int(sizes.sum())), sizes


def plain_tokenizer(full) -> tuple:
    """(tokenizer without normalizer and splitter, which ids close a word) with the same model; (None, None) if the file has unknown ones."""
    from tokenizers import Tokenizer, pre_tokenizers

    model, state = full.model, lambda x: json.loads(x.__getstate__()) if x is not None else None
    split = (state(full.pre_tokenizer) or {}).get("pretokenizers", [])
    known = state(full.normalizer) == NORMALIZER and len(split) == 2 and split[0] == SPLITTER and split[1] == state(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
    close = getattr(model, "end_of_word_suffix", None)
    if not known or not close or not set(close) & set("<'") or getattr(model, "dropout", None):
        return None, None  # PLAIN has neither of these characters, so only a word's end looks like one
    closes = np.zeros(full.get_vocab_size(), bool)
    closes[[i for x, i in full.get_vocab(with_added_tokens=False).items() if x.endswith(close)]] = True
    plain = Tokenizer(model)
    plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return plain, closes


def appended(starts: np.ndarray, n: int, values: np.ndarray, used: int, sizes: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """n lists, kept flat, with further ones behind them; the arrays grow by doubling."""
    while n + len(sizes) + 1 > len(starts):
        starts = np.concatenate([starts, np.zeros_like(starts)])
    while used + len(new) > len(values):
        values = np.concatenate([values, np.zeros_like(values)])
    values[used : used + len(new)] = new
    starts[n + 1 : n + len(sizes) + 1] = used + np.cumsum(sizes)
    return starts, values, used + len(new)


def equal_spans(a: np.ndarray, sa: np.ndarray, ea: np.ndarray, b: np.ndarray, sb: np.ndarray, eb: np.ndarray) -> np.ndarray:
    """Which spans of a and b have the same bytes."""
    out = (ea - sa) == (eb - sb)
    at = np.flatnonzero(out)
    size = (ea - sa)[at]
    for i in range(0, len(at), 1 << 16):
        own, n = at[i : i + (1 << 16)], size[i : i + (1 << 16)]
        who = np.repeat(np.arange(len(own)), n)
        inner = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        differs = a[sa[own][who] + inner] != b[sb[own][who] + inner]
        out[own[who[differs]]] = False
    return out


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans; the spans do not overlap."""
    step = np.zeros(n + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of what is encoded by itself; letters are lower-cased but in words that go whole."""
    lower, kind, odd = S.ASCII_LOWER[data], KIND[data], WHOLE[data]
    first, last, _ = S.words(data, offs, S.NOT_SPACE)
    if not len(first):
        return lower, first, last
    begins = np.zeros(len(data) + 1, bool)
    begins[offs] = True
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[at]
    at = at[(second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7) & ~begins[at]]  # not the signs of multiplication and division
    kind[at] = kind[at - 1] = 1
    odd[at] = odd[at - 1] = False
    lower[at[data[at] < 0x9F]] += 0x20
    odd = np.concatenate([[0], np.cumsum(odd)])
    whole = odd[last] > odd[first]
    as_is = covered(len(data), first[whole], last[whole])
    lower[as_is] = data[as_is]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    edge[1:-1] &= ~covered(len(data), first[whole] + 1, last[whole])[1:]
    edge[first] = edge[last] = True
    edge[offs] = True
    cuts = np.flatnonzero(edge)
    keep = kind[cuts[:-1]] > 0
    return lower, cuts[:-1][keep], cuts[1:][keep]


def encoded(data: np.ndarray, offs: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids without end tokens, and where each document's begin."""
    lower, start, end = spans(data, offs)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    names, at, back = np.unique(S.span_hash(S.prefix_hash(lower), start, end), return_index=True, return_inverse=True)
    place = words.places(names, lower, start[at], end[at])[back]
    odd = np.flatnonzero(~equal_spans(lower, start, end, lower, start[at[back]], end[at[back]]))
    if len(odd):  # words that share the hash of another word of this chunk
        place[odd] = words.encode(lower, start[odd], end[odd])
    low, size = words.start[place], words.start[place + 1] - words.start[place]
    before = np.concatenate([[0], np.cumsum(size)])
    ids = words.ids[np.repeat(low - before[:-1], size) + np.arange(before[-1])]
    return ids, before[np.searchsorted(start, offs)]


def decomposed(total: int, longest: int) -> list[int]:
    """Binary lengths, largest first, that add up to total."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(path: str, longest: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(path)
        for data, offs, rows in S.chunks(batches, CHUNK):
            ids, first = encoded(data, offs, words)
            # the end token goes behind each document
            n = len(first) - 1
            full = np.full(len(ids) + n, end, np.uint32)
            full[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(first))] = ids
            first = first + np.arange(n + 1)
            raw = memoryview(full.astype("<u4").tobytes())
            out: list[list] = [[], [], [], [], []]
            for d in range(n):
                at, total = int(first[d]), int(first[d + 1] - first[d])
                start = 0
                for length in decomposed(total, longest):
                    own = (d, start, length, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + length)]), total)
                    for column, value in zip(out, own):
                        column.append(value)
                    start += length
            doc = np.array(out[0], np.int64)
            columns = [rows.column("doc_id").take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in out[1:])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cuts = np.append(first[doc] + np.array(out[1], np.int64), len(full))  # pieces are in order and gapless
                columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(full.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset, bucket."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    out = S.plain(docs).mapInArrow(pieces(tokenizer, longest, end, with_ids), schema)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder for each length, so that a batch of one bucket needs no padding."""
    packed.write.partitionBy("bucket").parquet(path)
