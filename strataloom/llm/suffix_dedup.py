"""Suffix-array dedup: remove every byte that lies in a byte string of `length` found at another place too.

How it scales. Two equal strings of `length` bytes hold the same least k-gram hash, so the windows of a
document are cut into runs that share this minimum (one run per ~70 bytes). Only the runs' hashes are
shuffled, never the suffixes:

1. a map over the texts emits (m, h, doc_id, v, lo, n): minimum, hash of the run's bytes, place, windows;
2. minima that occur once (and not twice in their own run, as in periodic text) are dropped after a partially aggregated count (a hot minimum is one row a task);
3. runs with equal (m, h) are whole repeats and end here, so thousands of copies are never compared;
4. for minima with several different runs, one representative a run is cut from its text, and the
   suffixes at its windows are ordered: multikey quicksort to a shallow depth, then blind tries for the
   groups that still share their prefix. Neighbours that agree in `length` bytes are repeats;
5. the runs of a minimum with more than `hot` different ones (a passage in very many documents), or with more than
   `GROUP_WINDOWS` windows, stay in the batches in which they were cut. Each batch orders its own suffixes in the same way; what it finds repeated
   is final, and of equal windows only one goes on, by its hash, to a partially aggregated count over all
   batches. So no task gets an unbounded group, and a shared window is one row a batch.

Step 4 orders suffixes only where a k-gram repeats, which is where a repeated string can be; nothing is
capped or sampled. Hashes have 61 bits (of a run or window, in addition to its minimum).

Nulls and empty texts give n_bytes 0 and the digest of nothing; texts under `length` bytes are kept;
repeated rows (equal doc_id too) count as two places, each of which loses its repeats (rows of one
doc_id with different texts are told apart by v, 64 bits of the text's hash); an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared as S

LENGTH, GRAM, HOT = 200, 64, 4096
GROUP_WINDOWS = 300_000  # of one minimum in one task
CHUNK = 1 << 18
SHALLOW_WORDS = 4  # multikey quicksort goes this many 8-byte keys deep
MOST_WINDOWS = (1 << 15) - 1  # a longer run (periodic text) is cut; its parts meet again in their minimum
KEY = ["doc_id", "v"]
SPANS = "doc_id long, v long, s int, e int"


def sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = least(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return least(values[: len(values) - rest], values[rest:]) if rest else values


def window_minima(prefix: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the least hash of a k-gram in it; and window starts whose minimum is met twice nearby."""
    grams = S.window_hash(prefix, gram)
    width = length - gram + 1
    least = sliding(grams, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    anchors = np.flatnonzero(grams == sliding(np.concatenate([pad, least, pad]), width, np.maximum))
    i, j = anchors[:-1], anchors[1:]
    near = (grams[i] == grams[j]) & (j - i <= width)
    return least, np.clip(np.minimum(i[near], j[near] - width + 1), 0, len(least) - 1)


def runs_of(prefix: np.ndarray, offs: np.ndarray, length: int, gram: int, most: int = MOST_WINDOWS) -> tuple[np.ndarray, ...]:
    """(document, m, h, lo, n, own) of the runs of windows with one minimum, from prefix hashes of bytes or words.

    lo counts from the document's start; own: the minimum is met twice, so the run may repeat itself.
    """
    empty = np.zeros(0, np.int64)
    if len(prefix) <= length:
        return empty, empty, empty, empty, empty, empty
    least, twice = window_minima(prefix, length, gram)
    last = np.maximum(offs[1:] - length + 1, offs[:-1])  # one past the last window of each document
    edge = np.ones(len(least) + 1, bool)
    edge[1:-1] = least[1:] != least[:-1]
    bounds = np.concatenate([offs[:-1], last])
    edge[bounds[bounds <= len(least)]] = True
    cuts = np.flatnonzero(edge)
    lo, hi = cuts[:-1], cuts[1:]
    if (hi - lo).max(initial=0) > most:
        parts = -(-(hi - lo) // most)
        lo = np.repeat(lo, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        hi = np.minimum(lo + most, np.repeat(hi, parts))
    doc = np.searchsorted(offs, lo, "right") - 1
    own = np.zeros(len(lo), np.int64)
    own[np.searchsorted(lo, twice, "right") - 1] = 1
    fits = lo < last[doc]
    lo, hi, doc, own = lo[fits], hi[fits], doc[fits], own[fits]
    h = S.span_hash(prefix, lo, hi + length - 1)
    return doc, least[lo].view(np.int64), h.view(np.int64), lo - offs[doc], hi - lo, own


def cut_runs(length: int, gram: int):
    """Rows (doc_id, v, text): (m, h, doc_id, v, place) of each run, place holding lo, own and n in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offs, rows in S.chunks(batches, CHUNK):
            doc, m, h, lo, n, own = runs_of(S.prefix_hash(data), offs, length, gram)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(h), *(rows.column(k).take(take) for k in KEY), pa.array((lo << 16) | (own << 15) | n)], names=["m", "h", *KEY, "place"])

    return run


def unpacked(place: str) -> list:
    p = F.col(place)
    return [F.shiftright(p, 16).cast("int").alias("lo"), p.bitwiseAND(0x7FFF).cast("int").alias("n")]


# --- ordering suffixes ------------------------------------------------------------------------


def _ranks(changed: np.ndarray) -> np.ndarray:
    return np.cumsum(changed) - 1


def repeated_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes at `at` agree in `length` bytes with another of the same group.

    data needs 8 bytes more at its end. Shallow part: multikey quicksort, eight bytes a key, where only
    the suffixes that are still tied go on. Deep part: blind tries, all groups level by level.
    """
    key = np.ndarray(len(data) - 7, dtype=">u8", buffer=np.ascontiguousarray(data), strides=(1,))
    live, tie = np.arange(len(at)), group
    for depth in range(0, SHALLOW_WORDS * 8, 8):
        word = key[at[live] + depth].astype(np.uint64)
        order = np.lexsort((word, tie))
        live, tie, word = live[order], tie[order], word[order]
        new = np.ones(len(live), bool)
        new[1:] = (tie[1:] != tie[:-1]) | (word[1:] != word[:-1])
        rank = _ranks(new)
        many = np.bincount(rank, minlength=1)[rank] > 1 if len(rank) else np.zeros(0, bool)
        live, tie = live[many], rank[many]
        if not len(live):
            break
    return blind_tries(key, at, live, tie, SHALLOW_WORDS * 8, length)


def blind_tries(key: np.ndarray, at: np.ndarray, live: np.ndarray, tie: np.ndarray, depth: int, length: int) -> np.ndarray:
    """Leaves with two or more suffixes of blind tries, one a tie group, built from the root down.

    A node keeps only the depth to which all its suffixes agree and branches on the key there; the bytes
    between two nodes are never looked at again.
    """
    found = np.zeros(len(at), bool)
    deep = np.full(len(live), depth, np.int64)  # of each suffix's node
    words = [min(d, length - 8) for d in range(depth, length, 8)]
    while len(live):
        new = np.ones(len(live), bool)
        new[1:] = tie[1:] != tie[:-1]
        heads = np.flatnonzero(new)
        node = _ranks(new)
        base = at[live[heads[node]]]
        # the depth at which each suffix leaves its node's first one, then the node's least
        leave = np.full(len(live), length, np.int64)
        open_ = np.arange(len(live))
        for d in words:
            due = (deep[open_] < d + 8) & (d + 8 <= length)
            test = open_[due]
            differs = key[at[live[test]] + d] != key[base[test] + d]
            leave[test[differs]] = d
            due[np.flatnonzero(due)[~differs]] = False
            open_ = open_[~due]
            if not len(open_):
                break
        skip = np.minimum.reduceat(leave, heads)
        done = skip[node] >= length
        found[live[done]] = True
        rest = ~done
        live, tie, branch = live[rest], tie[rest], skip[node[rest]]
        if not len(live):
            break
        word = key[at[live] + branch].astype(np.uint64)
        order = np.lexsort((word, tie))
        live, tie, word, branch = live[order], tie[order], word[order], branch[order]
        new = np.ones(len(live), bool)
        new[1:] = (tie[1:] != tie[:-1]) | (word[1:] != word[:-1])
        rank = _ranks(new)
        many = np.bincount(rank)[rank] > 1
        live, tie, deep = live[many], rank[many], branch[many] + 8
    return found


def _spans(ids: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags with one id: (index of the first, of the last, id)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (ids[at[1:]] != ids[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], ids[at[first]]


def _result(t: pa.Table, who: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    take = pa.array(who)
    return pa.RecordBatch.from_arrays(
        [*(t.column(k).combine_chunks().take(take) for k in KEY), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=[*KEY, "s", "e"]
    )


def _windows(t: pa.Table) -> tuple[np.ndarray, ...]:
    """The pieces' bytes and, for each of their windows: piece, start in the bytes, start in its document, m."""
    data, offs = S.text_bytes(t.column("bytes").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
    data = np.concatenate([data[offs[0] : offs[-1]], np.zeros(8, np.uint8)])
    n = t.column("n").to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return data, owner, (offs[:-1] - offs[0])[owner] + inner, t.column("lo").to_numpy().astype(np.int64)[owner] + inner, t.column("m").to_numpy()[owner]


def sort_groups(length: int, most: int = 150_000):
    """Pieces (m, doc_id, v, lo, n, bytes), together by m: the repeated spans of their documents."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        data, owner, at, place, m = _windows(t)
        flags = repeated_windows(data, at, np.unique(m, return_inverse=True)[1], length)
        first, last, who = _spans(owner, flags)
        return _result(t, who, place[first], place[last] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0
        for batch in batches:
            while batch.num_rows:
                m, n = batch.column("m").to_numpy(), batch.column("n").to_numpy()
                if windows < most:
                    take = min(len(n), int(np.searchsorted(np.cumsum(n), most - windows)) + 1)
                else:  # only what belongs to the group that is open
                    other = m != held[-1].column("m")[held[-1].num_rows - 1].as_py()
                    take = int(other.argmax()) if other.any() else len(m)
                    if take < len(m):
                        yield solve([*held, batch.slice(0, take)])
                        held, windows, batch = [], 0, batch.slice(take)
                        continue
                held.append(batch.slice(0, take))
                windows += int(n[:take].sum())
                batch = batch.slice(take)
        if held:
            yield solve(held)

    return run


DEALT = "m long, hash long, doc_id long, v long, s int, e int"


def deal_windows(length: int):
    """For hot minima: spans that a batch finds repeated, with a null hash; one window of each kind, with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            data, owner, at, place, m = _windows(t)
            group = np.unique(m, return_inverse=True)[1]
            first, last, who = _spans(owner, repeated_windows(data, at, group, length))
            hashes = S.span_hash(S.prefix_hash(data), at, at + length)
            order = np.lexsort((hashes, m))
            new = np.ones(len(order), bool)
            new[1:] = (m[order][1:] != m[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
            one = order[new]
            rows = np.concatenate([who, owner[one]])
            spans = [np.concatenate([place[first], place[one]]), np.concatenate([place[last], place[one]]) + length]
            none = np.arange(len(rows)) < len(who)
            yield pa.RecordBatch.from_arrays(
                [
                    t.column("m").combine_chunks().take(pa.array(rows)), pa.array(np.concatenate([np.zeros(len(who), np.int64), hashes[one].view(np.int64)]), mask=none),
                    *(t.column(k).combine_chunks().take(pa.array(rows)) for k in KEY), *(pa.array(x.astype(np.int32)) for x in spans),
                ],
                names=["m", "hash", *KEY, "s", "e"],
            )

    return run


# --- the operator -----------------------------------------------------------------------------


def cut_bytes(length: int):
    """Rows (doc_id, v, text, want): the bytes of each wanted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offs, rows in S.chunks(batches, 1 << 22):
            want = rows.column("want")
            sizes = np.diff(want.offsets.to_numpy())
            flat = want.flatten()
            lo, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "n"))
            who = np.repeat(np.arange(rows.num_rows), sizes)
            raw, base = data.tobytes(), offs[who] + lo
            pieces = [raw[s:e] for s, e in zip(base, base + n + length - 1)]
            for i in range(0, len(pieces), 4000):
                part = slice(i, i + 4000)
                take = pa.array(who[part])
                yield pa.RecordBatch.from_arrays(
                    [flat.field("m").slice(i, 4000), *(rows.column(k).take(take) for k in KEY), *(flat.field(k).slice(i, 4000) for k in ("lo", "n", "deals")), pa.array(pieces[part], pa.binary())],
                    names=["m", *KEY, "lo", "n", "deals", "bytes"],
                )

    return run


def keep_rest(with_text: bool):
    """Rows (id, text, spans and a struct of carried columns): digest columns of what is left, and on demand the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offs, rows in S.chunks(batches, 1 << 22):
            raw = data.tobytes()
            out: list[list] = [[], [], [], [], []]
            spans = rows.column("spans").to_pylist()
            for i, own in enumerate(spans):
                text = raw[offs[i] : offs[i + 1]]
                merged: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in own or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                cuts = [0, *(x for span in merged for x in span), len(text)]
                kept = b"".join(text[cuts[j] : cuts[j + 1]] for j in range(0, len(cuts), 2))
                for column, value in zip(out, (len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None)):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([rows.column("key"), *arrays, rows.column("more")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "more"])

    return run


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, v, s, e): byte spans that lie in repeated strings; keyed has doc_id, v and text."""
    runs = keyed.filter(F.octet_length("text") >= length).mapInArrow(cut_runs(length, gram), "m long, h long, doc_id long, v long, place long")
    own = F.shiftright("place", 15).bitwiseAND(1)
    twice = S.materialise(runs.groupBy("m").agg(F.sum(1 + own).alias("times")).filter("times > 1").select("m"))
    cand = S.materialise(runs.join(twice, "m"))
    by_run = S.materialise(cand.groupBy("m", "h").agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "place")).alias("one")))
    whole = cand.join(by_run.filter("times > 1").select("m", "h"), ["m", "h"]).select(*KEY, *unpacked("place"))
    whole = whole.select(*KEY, F.col("lo").alias("s"), (F.col("lo") + F.col("n") + F.lit(length - 1)).alias("e"))
    # a table of its own, so that the join with it deals by_run out by itself and a hot minimum can be split or the table broadcast
    place = F.col("one.place")
    kinds = by_run.groupBy("m").agg(F.sum(1 + F.shiftright(place, 15).bitwiseAND(1)).alias("kinds"), F.sum(place.bitwiseAND(0x7FFF)).alias("windows"))
    kinds = S.materialise(kinds.filter("kinds > 1").select("m", F.ceil(F.greatest(F.col("kinds") / hot, F.col("windows") / GROUP_WINDOWS)).cast("int").alias("deals")))
    want = by_run.join(kinds, "m").select("m", "one.*", "deals")
    per_row = want.select("m", *KEY, *unpacked("place"), "deals").groupBy(*KEY).agg(F.collect_list(F.struct("m", "lo", "n", "deals")).alias("want"))
    pieces = S.materialise(keyed.join(per_row, KEY).select(*KEY, "text", "want").mapInArrow(cut_bytes(length), "m long, doc_id long, v long, lo int, n int, deals int, bytes binary"))
    usual = pieces.filter("deals = 1").repartition("m").sortWithinPartitions("m").mapInArrow(sort_groups(length), SPANS)
    dealt = S.materialise(pieces.filter("deals > 1").mapInArrow(deal_windows(length), DEALT))
    again = dealt.filter("hash is not null").groupBy("m", "hash").agg(F.count("*").alias("times")).filter("times > 1").select("m", "hash")
    busy = dealt.filter("hash is null").select(*KEY, "s", "e").unionByName(dealt.join(again, ["m", "hash"]).select(*KEY, "s", "e"))
    return whole.unionByName(usual).unionByName(busy)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of each row, then the columns to carry along.

    kept_text is what is left as UTF-8; a character of which a repeat cut away only a part is dropped. A carried column
    may have any name; one that is called like a column of the result stands beside it under the same name.
    """
    carry = carry or []
    nowhere = -(2**63)  # stands for a null doc_id in joins
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    v = F.xxhash64(text)
    # carried columns travel in a struct, so that their names clash with none that are made here
    more = F.struct(F.lit(None).cast("int").alias("none"), *(F.col(f"`{c}`") for c in carry))
    keyed = docs.select(key.alias("key"), F.coalesce(key, F.lit(nowhere)).alias("doc_id"), v.alias("v"), text.alias("text"), more.alias("more"))
    spans = repeated_spans(keyed.select(*KEY, "text"), length, gram, hot).groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    own = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text]
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string").add("more", keyed.schema["more"].dataType)
    done = keyed.join(spans, KEY, "left").select("key", "text", "spans", "more").mapInArrow(keep_rest(with_text), schema)
    return done.select(*own, *(F.col(f"more.`{c}`").alias(c) for c in carry))
