"""Helpers that several training-data operators use: materialised tables, columns, Arrow text, hashing.

Text is handled as the UTF-8 bytes that Arrow hands over, in chunks of bounded size, so that one
vectorised pass covers many documents and a very long document only makes its own chunk longer.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs on one machine (tests), a new local one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/strataloom-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the tables that this session's operators have written; results that still read them are lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def plain(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and text columns, so that further columns with clashing names do no harm."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Arrow text -------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(bytes, offsets from 0, rows) for runs of rows of about `most` bytes; a longer text is a run by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = text_bytes(batch.column(batch.schema.get_field_index("text")))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
            j = min(j, n)
            yield data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], batch.slice(i, j - i)
            i = j
    release()


def release() -> None:
    """Give freed memory back at the end of a task: workers are used again, and what they keep adds up over stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `most` bytes of a string column; a longer text is a batch by itself."""
    for batch in batches:
        if batch.num_rows:
            _, offs = text_bytes(batch.column(batch.schema.get_field_index(column)))
            i = 0
            while i < batch.num_rows:
                j = min(batch.num_rows, max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1))
                yield batch.slice(i, j - i)
                i = j


# --- hashing ----------------------------------------------------------------------------------

#: Hashes of spans are polynomials modulo the prime 2^61 - 1: unlike modulo 2^64, no base has strings of
#: special form (Thue-Morse words, say) that collide; two strings of n bytes do by chance of n / 2^61.
PRIME = U64(2**61 - 1)
LOW31, LOW30, LOW29 = U64(2**31 - 1), U64(2**30 - 1), U64(2**29 - 1)
BASE = 0x9E3779B97F4A7C1 % (2**61 - 1)
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.permutation(np.arange(1, 1 + 256, dtype=np.uint64)) * U64(2**20) + _RNG.integers(0, 2**20, 256, dtype=np.uint64)
PART = 1 << 15  # numbers that are worked on at once, so that intermediate results stay in the processor's cache
_POWERS: dict[str, np.ndarray] = {}

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Fixed: words are runs of bytes other than space, tab, line feed, vertical tab, form feed, return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Fixed: words are runs of digits, a-z (after lower-casing) and all bytes above 0x7F.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True


def reduced(x: np.ndarray) -> np.ndarray:
    """x below 2^63, modulo the prime."""
    x = (x & PRIME) + (x >> U64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime."""
    out = np.empty(len(a), np.uint64)
    for i in range(0, len(a), PART):
        x, y = a[i : i + PART], b[i : i + PART]
        xu, xd, yu, yd = x >> U64(31), x & LOW31, y >> U64(31), y & LOW31
        middle = xd * yu + xu * yd
        out[i : i + PART] = reduced(((xu * yu) << U64(1)) + (middle >> U64(30)) + ((middle & LOW30) << U64(31)) + xd * yd)
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo the prime to the powers 0..n-1."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for name, base in (("p", BASE), ("q", pow(BASE, -1, int(PRIME)))):
            out = np.ones(size, np.uint64)
            k = 1
            while k < size:
                out[k : 2 * k] = product(out[:k], np.full(k, pow(base, k, int(PRIME)), np.uint64))
                k *= 2
            _POWERS[name] = out
    return _POWERS["p"][:n], _POWERS["q"][:n]


def prefix_hash(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """P of n+1 entries, from which span_hash takes the hash of any span in constant time. code has 29 bits."""
    n = len(data)
    power, out, before = powers(n)[0], np.zeros(n + 1, np.uint64), U64(0)
    for i in range(0, n, PART):
        c, w = code[data[i : i + PART]], power[i : i + PART]
        middle, low = c * (w >> U64(31)), c * (w & LOW31)
        x = (middle >> U64(30)) + ((middle & LOW30) << U64(31)) + low
        high, low = np.cumsum(x >> U64(32)), np.cumsum(x & U64(2**32 - 1))
        out[i + 1 : i + 1 + len(c)] = reduced((high >> U64(29)) + ((high & LOW29) << U64(32)) + low + before)
        before = out[i + len(c)]
    return out


def prefix_of(values: np.ndarray) -> np.ndarray:
    """prefix_hash of a sequence of 64-bit hashes, so that span_hash tells spans of it (runs of words, say) apart."""
    n = len(values)
    power, out, before = powers(n)[0], np.zeros(n + 1, np.uint64), U64(0)
    for i in range(0, n, PART):
        x = product(reduced(values[i : i + PART] >> U64(2)), power[i : i + PART])
        high, low = np.cumsum(x >> U64(32)), np.cumsum(x & U64(2**32 - 1))
        out[i + 1 : i + 1 + len(x)] = reduced((high >> U64(29)) + ((high & LOW29) << U64(32)) + low + before)
        before = out[i + len(x)]
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(product(reduced(prefix[end] + (PRIME - prefix[start])), powers(len(prefix))[1][start]))


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """span_hash of all spans of one width."""
    n = len(prefix) - width
    return mix(product(reduced(prefix[width:] + (PRIME - prefix[:n])), powers(len(prefix))[1][:n]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def words(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of member bytes that stay in one document) and the words before each document."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = member[data]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = inside[1:] != inside[:-1]
    edge[offs] = True
    cuts = np.flatnonzero(edge)
    keep = inside[cuts[:-1]]
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    return starts, ends, np.searchsorted(starts, offs, "left")


def grams(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words in each document and, per run, its document; a shorter document is one run."""
    counts = np.diff(first)
    total = len(hashes)
    got = np.zeros(total, np.uint64)
    k = U64(0xA0761D6478BD642F)
    mult = U64(1)
    for i in range(size):
        mult = U64((int(mult) * int(k)) % 2**64)
        if i < total:
            got[: total - i] += hashes[i:] * mult
    runs = np.where(counts >= size, counts - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first[:-1], runs)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return mix(got[at]), doc
    extra = np.zeros(len(short), np.uint64)
    for x, d in enumerate(short):
        mult, value = U64(1), int(counts[d])
        for i in range(first[d], first[d + 1]):
            mult = U64((int(mult) * int(k)) % 2**64)
            value = (value + int(hashes[i]) * int(mult)) % 2**64
        extra[x] = value
    both = np.concatenate([doc, short])
    order = np.argsort(both, kind="stable")
    return np.concatenate([mix(got[at]), mix(extra)])[order], both[order]
