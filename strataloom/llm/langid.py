"""Language ID by Bayesian evidence fusion.

Evidence about a page: the likelihood of its text under byte-trigram models of each language; the language that
the markup declares; the address suffix; and a prior of its host. The trigram models are counts over every
document with a language (one map, then a sum per language and bucket). The other tables are counts of the
text's first guess, made by grouped aggregation over all pages: P(declared | language), P(suffix | language)
and, for the prior, host counts smoothed by those of the registered domain, which are smoothed by all pages'.
Groups are partially aggregated, so a host with a third of the pages is one row a task.

A page without html, without text, or of a language none of the models knows gets its answer from the evidence
that is left; without any model the language is null. Null urls have an empty host; repeated rows count each;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

BUCKETS = 4096
CHUNK = 1 << 20
#: A text counts as so many independent trigrams at most: neighbouring trigrams of a long text are far from independent,
#: and without a bound the text alone would decide each page, whatever its markup and host say. A parameter of train().
TEXT_WEIGHT = 40.0
MARKUP = re.compile(r"<(script|style|head)\b|<!--|<[^>]*>|&#?\w+;", re.I | re.A)
CLOSING = {tag: re.compile(rf"</{tag}\s*>", re.I | re.A) for tag in ("script", "style", "head")}
DECLARED = re.compile(r"<html\b[^>]*", re.I | re.A)
LANG = re.compile(r"\blang\s*=\s*[\"']?([a-z]{2,3})", re.I | re.A)


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each byte trigram (ASCII letters lower-cased, white space and digits as one)."""
    low = S.ASCII_LOWER[data].astype(np.uint32)
    low[~((low >= 97) & (low < 123) | (low >= 128))] = 32
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    at = np.arange(len(code))
    doc = np.searchsorted(offs, at, "right") - 1
    keep = (at + 3 <= offs[doc + 1]) & (code != 0x202020)
    return (((code.astype(np.uint64) * S.U64(0x9E3779B97F4A7C15)) >> S.U64(52)).astype(np.int64))[keep], doc[keep]


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for data, offs, rows in S.chunks(batches, CHUNK):
        bucket, doc = trigrams(data, offs)
        names, kind = np.unique(np.array(rows.column("lang").to_pylist(), str), return_inverse=True)
        for k, name in enumerate(names):
            got = np.bincount(bucket[kind[doc] == k], minlength=BUCKETS)
            counts[str(name)] = counts.get(str(name), 0) + got
    for name, got in counts.items():
        used = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(got[used])], names=["lang", "bucket", "n"])


class TextModel:
    """Log probabilities of buckets; languages by name. BUCKETS numbers a language."""

    def __init__(self, rows: list, text_weight: float = TEXT_WEIGHT):
        self.text_weight = text_weight
        self.languages = sorted({r[0] for r in rows})
        counts = np.zeros((len(self.languages), BUCKETS))
        at = {x: i for i, x in enumerate(self.languages)}
        for lang, bucket, n in rows:
            counts[at[lang], bucket] = n
        smooth = counts + 0.5
        self.log = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)

    def likelihoods(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Log likelihood of each text, one column a language, of at most text_weight trigrams' weight."""
        bucket, doc = trigrams(data, offs)
        n = len(offs) - 1
        size = np.bincount(doc, minlength=n)
        total = np.stack([np.bincount(doc, row[bucket], minlength=n) for row in self.log], 1) if len(self.languages) else np.zeros((n, 0))
        return total * (np.minimum(size, self.text_weight) / np.maximum(size, 1))[:, None]


def train(docs: DataFrame, text_weight: float = TEXT_WEIGHT) -> TextModel:
    """Trigram counts over all documents that have a language, of every language: BUCKETS rows a language on the driver, however many documents."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = rows.mapInArrow(count_buckets, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return TextModel([tuple(r) for r in counts.collect()], text_weight)


def page_text(page: str | None) -> str:
    """The page without tags, comments, character references, scripts, styles and its head; linear in its length."""
    page = page or ""
    out, at, last, no_end = [], 0, page.rfind(">"), set()
    most = max(last, page.rfind("&"))
    for found in iter(lambda: MARKUP.search(page, at) if at <= most else None, None):
        out.append(page[at : found.start()])
        at = found.end()
        tag = (found[1] or "").lower()
        if tag and tag not in no_end:
            end = CLOSING[tag].search(page, at)
            if end:
                at = end.end()
                continue
            no_end.add(tag)
        if tag or found[0] == "<!--":
            end = page.find(">" if tag else "-->", at) if at <= last else -1
            at = at if end < 0 else end + (1 if tag else 3)
    out.append(page[at:])
    return " ".join(out)


def declared_language(page: str | None) -> str | None:
    html = DECLARED.search(page or "")
    found = LANG.search(html[0]) if html else None
    return found[1].lower() if found else None


def evidence(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in S.chunks(batches, CHUNK):
            pages = rows.column("text").to_pylist()
            data, offs = S.text_bytes(pa.array([page_text(x) for x in pages], pa.string()))
            got = model.likelihoods(data[offs[0] : offs[-1]], offs - offs[0])
            declared = [declared_language(x) for x in pages]
            best = [model.languages[i] if len(model.languages) and row.any() else None for i, row in zip(got.argmax(1) if got.shape[1] else [0] * len(pages), got)]
            cuts = pa.array((np.arange(len(pages) + 1) * got.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rows.column("page_id"), rows.column("url"), pa.array(declared, pa.string()), pa.array(best, pa.string()), pa.ListArray.from_arrays(cuts, pa.array(got.ravel()))],
                names=["page_id", "url", "declared", "text_lang", "likelihood"],
            )

    return run


def _counts(frame: DataFrame, keys: list[str], languages: list[str], name: str) -> DataFrame:
    """Pages by first guess, as an array in the order of the languages, one row a key."""
    own = frame.groupBy(*keys).agg(*(F.count_if(F.col("text_lang") == x).alias(f"c{i}") for i, x in enumerate(languages)))
    return own.select(*keys, F.array(*(F.col(f"c{i}").cast("double") for i in range(len(languages)))).alias(name))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def bound(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _smoothed(own: Column, above: Column, strength: float) -> Column:
    """Dirichlet smoothing of counts by the level above."""
    return F.transform(own, lambda x, i: (x + strength * F.element_at(above, i + 1)) / (_total(own) + strength))


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, url, lang, confidence, and the evidence: declared, text_lang, suffix, host."""
    languages = model.languages
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("text"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1)), F.lit(""))
    seen = rows.mapInArrow(evidence(model), "page_id long, url string, declared string, text_lang string, likelihood array<double>").withColumn("host", host)
    seen = seen.withColumns({"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2), "declared": F.coalesce("declared", F.lit(""))})
    if not languages:
        return seen.select("page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), "declared", "text_lang", "suffix", "host")
    seen = S.materialise(seen)
    hosts = S.materialise(seen.groupBy("host", "domain", "suffix", "text_lang").agg(F.count("*").alias("n")))
    sums = lambda keys, name: hosts.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("text_lang") == x, F.col("n"))), F.lit(0)).cast("double").alias(f"c{i}") for i, x in enumerate(languages))).select(*keys, F.array(*(F.col(f"c{i}") for i in range(len(languages)))).alias(name))
    everything = hosts.groupBy("text_lang").agg(F.sum("n")).filter("text_lang is not null").collect()  # a row a language
    total = {r[0]: r[1] for r in everything}
    world = [(total.get(x, 0) + 1.0) / (sum(total.values()) + len(languages)) for x in languages]
    all_pages = F.array(*(F.lit(x) for x in world))
    counted = sums(["host", "domain"], "of_host").join(sums(["domain"], "of_domain"), "domain").drop("domain")
    # a page's own guess is not evidence of its host: it is taken out of both counts
    others = lambda c: F.transform(c, lambda x, i: x - (F.element_at(names, i + 1) == F.coalesce("text_lang", F.lit(""))).cast("double"))
    names = F.array(*(F.lit(x) for x in languages))
    prior = bound(others(F.col("of_domain")), lambda d: bound(_smoothed(d, all_pages, 20.0), lambda above: bound(others(F.col("of_host")), lambda h: _smoothed(h, above, 10.0))))
    # P(suffix | language) and P(declared | language), each smoothed by its overall share
    given = lambda frame, key, n: frame.select(key, F.transform(F.col(n), lambda x, i: (x + F.lit(1.0)) / (F.element_at(F.array(*(F.lit(float(total.get(y, 0) + 50)) for y in languages)), i + 1))).alias(f"{key}_given"))
    suffixes = given(sums(["suffix"], "of_suffix"), "suffix", "of_suffix")
    marks = given(_counts(seen, ["declared"], languages, "of_mark"), "declared", "of_mark")
    joined = seen.join(counted, "host", "left").withColumn("prior", prior).join(suffixes, "suffix", "left").join(marks, "declared", "left")
    log = lambda c, i: F.ln(F.greatest(F.coalesce(F.element_at(c, i + 1), F.lit(1.0)), F.lit(1e-6)))
    posterior = F.transform("likelihood", lambda x, i: x + log(F.col("prior"), i) + log(F.col("suffix_given"), i) + log(F.col("declared_given"), i))
    weight = F.transform("posterior", lambda x: F.exp(x - F.array_max("posterior")))
    best = F.element_at(F.array(*(F.lit(x) for x in languages)), F.array_position("posterior", F.array_max("posterior")).cast("int"))
    out = joined.withColumn("posterior", posterior).withColumn("weight", weight)
    return out.select("page_id", "url", best.alias("lang"), (1.0 / _total(F.col("weight"))).alias("confidence"), "declared", "text_lang", "suffix", "host")
