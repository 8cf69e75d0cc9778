"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

One map over the texts measures each document. The measures of documents that pass the base rule feed KLL
sketches and sums, one a (lang, source) group and measure: partially aggregated, so a group that holds a third of all
rows is one sketch per task before the shuffle. They give a group's middle (median), its spread (distance between its
quartiles, so that odd rows do not move it before they are a quarter of their group) and its rate (mean). The limits, a
row a group, are joined back. A measure may be `reach` spreads off the middle. Most shares are 0 for most documents,
so the quartiles of many groups coincide; the spread is then that which a document of its size has by chance at its
group's rate: sqrt(unit * rate / n) for a share of n words or lines that comes in units (a symbol, a line, the six words
of a repeated window), with one unit as the least rate; sqrt(middle / n) for the mean length of n words. No limit
is a fixed number. Documents without a limit (group without usable rows) are kept if the base rule keeps them.

Groups of up to SKETCH_K rows get exact quantiles; of larger ones the sketch, which is randomised, is off by
some 0.1 per cent of the ranks. The limits are rounded to four places and written down once a run, so all rows of a run,
retried tasks too, are judged by the same ones; for the same limits in several runs pass them as `bounds`.

Null and empty texts have no words and fail the base rule; null lang and source are groups of their own;
repeated rows count and are judged each for itself; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

LEAST_WORDS, MOST_REPEATED = 50, 50  # words; per cent of the words in repeated 3-word windows
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
CHUNK = 1 << 21
#: measure -> (has a lower limit, what it is a share of, what a unit of it is); word_length is no share.
MEASURES = {"word_length": (True, "n_words", 0), "symbol_share": (False, "n_words", 1), "line_share": (False, "n_lines", 1), "repeat_share": (False, "n_words", 6)}
REACH, SKETCH_K = 5.0, 4096
SCHEMA = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeats(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each key, how often its document has it."""
    order = np.lexsort((keys, doc))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.cumsum(new) - 1
    out = np.zeros(len(order), np.int64)
    if len(order):
        out[order] = np.bincount(rank)[rank]
    return out


def measured(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) of each document."""
    n_docs = len(offs) - 1
    starts, ends, first = S.words(data, offs, S.NOT_SPACE)
    zero = np.zeros(n_docs, np.int64)
    if not len(data):
        return [zero] * 6
    before = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    symbols = before(SYMBOLS[data])
    symbols = symbols[offs[1:]] - symbols[offs[:-1]]
    if not len(starts):
        return [zero, zero, symbols, zero, zero, zero]
    points = before((data & 0xC0) != 0x80)
    chars = before(points[ends] - points[starts])
    chars = chars[first[1:]] - chars[first[:-1]]
    prefix = S.prefix_hash(data)
    # lines with a word, against earlier ones
    member = np.ones(256, bool)
    member[10] = False
    line_s, line_e, line_first = S.words(data, offs, member)
    words_before = np.searchsorted(starts, line_s), np.searchsorted(starts, line_e)
    full = words_before[1] > words_before[0]
    line_doc = np.repeat(np.arange(n_docs), np.diff(line_first))[full]
    lines = S.span_hash(prefix, line_s[full], line_e[full])
    order = np.lexsort((lines, line_doc))
    same = (lines[order][1:] == lines[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    dup_lines = np.bincount(line_doc[order][1:][same], minlength=n_docs)
    # words in 3-word windows that the document has twice or more
    counts = np.diff(first)
    runs = np.maximum(counts - 2, 0)
    doc = np.repeat(np.arange(n_docs), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first[:-1], runs)
    h = S.span_hash(prefix, starts, ends)
    k = S.U64(0xA0761D6478BD642F)
    window = S.mix(((h[at] * k + h[at + 1]) * k + h[at + 2]) * k) if len(at) else np.zeros(0, np.uint64)
    twice = at[repeats(window, doc) > 1]
    marked = np.zeros(len(starts) + 2, bool)
    for i in range(3):
        marked[twice + i] = True
    marks = before(marked)
    return [counts, chars, symbols, dup_lines, marks[first[1:]] - marks[first[:-1]], np.bincount(line_doc, minlength=n_docs)]


def measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "lang", "source"]
    for data, offs, rows in S.chunks(batches, CHUNK):
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *(pa.array(x.astype(np.int64)) for x in measured(data, offs))], names=[*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])


def measure(docs: DataFrame) -> DataFrame:
    """The base measures, and base_failed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.mapInArrow(measure_rows, SCHEMA).withColumn("base_failed", failed)


def shares() -> dict:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return {"word_length": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / words, "line_share": lines, "repeat_share": F.col("n_repeat_words") / words}


def sketches(measures: DataFrame) -> DataFrame:
    """One row a (lang, source): its rows, and for each measure a KLL sketch and a sum. Those of parts can be merged (merge_sketches)."""
    own = shares().items()
    each = [*(F.kll_sketch_agg_double(x, SKETCH_K).alias(name) for name, x in own), *(F.sum(x).alias(f"{name}_sum") for name, x in own)]
    return measures.filter("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("rows"), *each)


def merge_sketches(parts: DataFrame) -> DataFrame:
    """Sketches of several tables or days, merged by group."""
    sums = [F.sum(c).alias(c) for c in ("rows", *(f"{name}_sum" for name in MEASURES))]
    return parts.groupBy("lang", "source").agg(*(F.kll_merge_agg_double(F.col(name), SKETCH_K).alias(name) for name in MEASURES), *sums)


def limits(sketched: DataFrame, reach: float = REACH) -> DataFrame:
    """lang, source and for each measure the middle, the spread and the rate of the group, and its own high limit."""
    out = []
    at = lambda name, q: F.kll_sketch_get_quantile_double(F.col(name), F.lit(q))
    places = lambda x: F.floor(x * 10_000 + 0.5) / F.lit(10_000.0)
    for name in MEASURES:
        middle, spread = places(at(name, 0.5)), places(at(name, 0.75) - at(name, 0.25))
        out += [middle.alias(f"{name}_middle"), spread.alias(f"{name}_spread"), places(F.col(f"{name}_sum") / F.col("rows")).alias(f"{name}_rate"), (middle + reach * spread).alias(f"{name}_high")]
    return sketched.select("lang", "source", *out)


def judge(measures: DataFrame, bounds: DataFrame, reach: float = REACH) -> DataFrame:
    """measures with kept."""
    right = bounds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(c for c in bounds.columns if c not in ("lang", "source")))
    both = measures.join(right, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    odd = F.lit(False)
    for name, x in shares().items():
        lower, of, unit = MEASURES[name]
        n = F.greatest(F.col(of), F.lit(1)).cast("double")
        middle = F.col(f"{name}_middle")
        by_chance = F.sqrt(unit * F.greatest(F.col(f"{name}_rate"), unit / n) / n) if unit else F.sqrt(middle / n)
        width = reach * F.greatest(F.col(f"{name}_spread"), by_chance)
        beyond = (x > middle + width) | (x < middle - width) if lower else x > middle + width
        odd = odd | F.coalesce(beyond, F.lit(False))
    return both.withColumn("kept", ~F.col("base_failed") & ~odd)


def quality_rules(docs: DataFrame, reach: float = REACH, bounds: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept. bounds: given limits()."""
    measures = S.materialise(measure(docs))
    out = judge(measures, S.materialise(limits(sketches(measures), reach)) if bounds is None else bounds, reach)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def brute_kept(rows: list[tuple], reach: float = REACH) -> dict:
    """kept of rows (doc_id, lang, source, text) in plain Python, for tests; exact quantiles."""
    import math

    base = {r[0]: b for r, b in zip(rows, brute_force([(r[0], r[3]) for r in rows]))}
    lines = {r[0]: max(1, sum(1 for x in (r[3] or "").split("\n") if x.strip(" \t\n\v\f\r"))) for r in rows}
    own = lambda k: {"word_length": base[k][2] / max(1, base[k][1]), "symbol_share": base[k][3] / max(1, base[k][1]), "line_share": base[k][4] / lines[k], "repeat_share": base[k][5] / max(1, base[k][1])}
    places = lambda x: math.floor(x * 10_000 + 0.5) / 10_000.0
    groups: dict[tuple, list] = {}
    for r in rows:
        if not base[r[0]][6]:
            groups.setdefault(r[1:3], []).append(own(r[0]))
    out = {}
    for k, lang, source, _ in rows:
        kept, x = not base[k][6], own(k)
        for name, (lower, of, unit) in MEASURES.items():
            values = sorted(g[name] for g in groups.get((lang, source), []))
            if values:
                at = lambda q: values[max(0, math.ceil(q * len(values)) - 1)]  # noqa: B023, E731
                n = float(max(1, base[k][1] if of == "n_words" else lines[k]))
                middle, rate = places(at(0.5)), places(sum(values) / len(values))
                width = reach * max(places(at(0.75) - at(0.25)), math.sqrt(unit * max(rate, unit / n) / n) if unit else math.sqrt(middle / n))
                kept &= x[name] <= middle + width and not (lower and x[name] < middle - width)
        out[k] = kept
    return out


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The base measures in plain Python, for tests: doc_id ... base_failed."""
    import re
    from collections import Counter

    split = re.compile("[^\\x20\\x09-\\x0D]+")
    out = []
    for doc_id, text in docs:
        text = text or ""
        w = split.findall(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if split.search(x)]
        out.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return out
