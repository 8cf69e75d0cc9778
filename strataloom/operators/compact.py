"""Compaction of logs and prose: line relations, summaries, extractive compression, compressor statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import predicates as P
from strataloom.functions import text as T
from strataloom.session import spread


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line from 1, text) of the lines of each text."""
    return docs.select(key, F.posexplode(T.lines_of(F.col(text))).alias("pos", "text")).select(key, (F.col("pos") + 1).alias("line"), "text")


def flagged(line: Column, kinds: dict[str, str], *more: Column) -> Column:
    """A struct of `more` and, for each kind, whether the line matches its pattern; the line is lower-cased once."""
    return T.bind(F.lower(line), lambda low: F.struct(*more, *(P.matches(line, p, low).alias(k) for k, p in kinds.items())))


def line_flags(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many lines of each text are errors, commands, stack frames, decisions, actions, risks and questions."""
    kinds = {"errors": P.ERROR, "commands": P.COMMAND, "stack_frames": P.STACK, "decisions": P.DECISION, "actions": P.ACTION, "risks": P.RISK, "questions": P.QUESTION}
    flags = F.transform(T.lines_of(F.coalesce("text", F.lit(""))), lambda x: flagged(x, kinds))
    of = lambda k: lambda x: x[k]
    count = lambda f: F.struct(F.size(f).alias("n_lines"), *(F.size(F.filter(f, of(k))).alias(k) for k in kinds))
    return spread(docs.select(key, "text")).select(key, T.bind(flags, count).alias("c")).select(key, "c.*")


def paired_lines(rows: Column) -> Column:
    """Structs of each line: as it is, trimmed, and the trimmed line behind it."""
    pair = lambda t: F.arrays_zip(rows.alias("line"), t.alias("own"), F.slice(t, F.lit(2), F.size(t)).alias("next"))
    return T.bind(F.transform(rows, T.trim), pair)


def picked(items: Column, kind: str, value: Column | str, most: int) -> Column:
    """The distinct values of the flagged items of a kind."""
    get = value if callable(value) else lambda x: x[value]
    return T.unique_ci(F.transform(F.filter(items, lambda x: x[kind]), get), most)


def log_summary(docs: DataFrame, key: str = "doc_id", most_chars: int = 8000, context: str = "build/test/runtime logs", most_input: int | None = None) -> DataFrame:
    """Commands, errors with their next line, stack frames, files, root cause, checks, tail, compact text, statistics.

    Whole texts, unless `most_input` gives a number of characters. Each line is tested once, so the work is linear in the lines.
    """
    norm = F.replace(T.strip_ansi(F.coalesce("text", F.lit(""))), F.lit("\r\n"), F.lit("\n"))
    rows = spread(docs.select(key, "text")).select(key, (F.substring(norm, 1, most_input) if most_input else norm).alias("norm")).withColumn("rows", F.split("norm", "\n"))
    has = lambda pattern: F.exists("errors", lambda x: P.matches(x, pattern))
    bullets = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(title + ":\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")))
    flags = lambda z: T.bind(F.lower(z["own"]), lambda low: F.struct(z["line"].alias("line"), z["own"].alias("own"), z["next"].alias("next"), ((z["own"] != "") & P.matches(z["own"], P.ERROR, low)).alias("error"), P.matches(z["own"], P.COMMAND, low).alias("command"), P.matches(z["line"], P.STACK).alias("stack")))
    # only lines with a flag stay, so what follows is short for most texts
    marked = F.filter(F.transform(paired_lines(F.col("rows")), flags), lambda x: x["error"] | x["command"] | x["stack"])
    with_next = lambda x: F.when((x["next"] != "") & (F.length(x["next"]) < 240), F.concat(x["own"], F.lit("\n"), x["next"])).otherwise(x["own"])
    parts = lambda m: F.struct(picked(m, "command", "own", 12).alias("commands"), picked(m, "error", with_next, 18).alias("errors"), picked(m, "stack", "line", 18).alias("stack_frames"))
    out = rows.withColumns(
        {
            "marked": T.bind(marked, parts),
            "files": T.unique_ci(F.regexp_extract_all("norm", F.lit(P.FILE), 1), 24),
            "tail": T.clamp_head_tail(T.trim(F.array_join(F.slice(F.col("rows"), F.greatest(F.lit(1), F.size("rows") - 79), F.lit(80)), "\n")), 2500),
        }
    ).select(key, "norm", "marked.*", "files", "tail")
    quiet = F.filter("errors", lambda x: ~P.matches(x, "(warning|deprecated|notice)"))
    out = out.withColumn("root_cause", F.coalesce(F.get(quiet, F.lit(0)), F.get("errors", F.lit(0)), F.lit("No clear error line detected. Use raw_log_url if the failure is hidden in omitted output.")))
    # fixed values: the sentences, in their order
    checks = F.array_compact(
        F.array(
            F.lit("Re-run the smallest failing command, not the whole pipeline."), F.lit("Inspect the first real error before later cascading failures."),
            F.when(F.size("files") > 0, F.concat(F.lit("Open impacted files first: "), F.array_join(F.slice("files", 1, 5), ", "))),
            F.when(has("timeout|timed out"), F.lit("Check whether this is a real failure or an infra/network timeout.")),
            F.when(has("permission|denied|eacces"), F.lit("Check file permissions, env vars, and service user before changing app code.")),
            F.when(has("not found|cannot find"), F.lit("Check missing dependency/path/import before editing business logic.")),
        )
    )
    out = out.withColumn("checks", checks)
    compact = F.concat_ws(
        "\n\n", F.lit(f"Context: {context}"), bullets("Failing / relevant commands", F.col("commands")), F.concat(F.lit("Likely root cause:\n"), "root_cause"), bullets("Top errors", F.col("errors")),
        bullets("Stack frames", F.col("stack_frames")), bullets("Impacted files", F.col("files")), bullets("Suggested next checks", F.col("checks")), F.concat(F.lit("Log tail:\n"), "tail"),
    )
    out = out.withColumn("compact", T.clamp_head_tail(compact, most_chars))
    n = F.size("errors")
    raw, small = T.estimate_tokens("norm"), T.estimate_tokens("compact")
    saved, pct = T.savings(raw, small)
    return out.select(key, "commands", "errors", "stack_frames", "files", "root_cause", "checks", "tail", "compact", raw.alias("raw_tokens"), small.alias("compact_tokens"), saved.alias("saved_tokens"), pct.alias("savings_pct"), F.when(n == 0, 0.08).when(n > 14, 0.05).otherwise(0.02).alias("uncertainty"))


def text_summary(docs: DataFrame, key: str = "doc_id", most_chars: int = 7000, purpose: str = "compact long text for frontier model context", most_input: int | None = None, most_lines: int = 400) -> DataFrame:
    """Summary lines, decisions, actions, questions, risks, carried text, compact text and statistics.

    The lists come from the first `most_lines` lines that are not empty, as a summary's first lines are the feature.
    """
    norm = T.normalise_space(F.coalesce("text", F.lit("")))
    rows = spread(docs.select(key, "text")).select(key, (F.substring(norm, 1, most_input) if most_input else norm).alias("norm")).withColumn("rows", T.first_lines(F.col("norm"), most_lines))
    kinds = {"decision": P.DECISION, "action": P.ACTION, "question": P.QUESTION, "risk": P.RISK}
    flags = F.transform("rows", lambda x, i: flagged(x, kinds, x.alias("x"), i.alias("i")))
    any_of = lambda x: x["decision"] | x["action"] | x["risk"] | x["question"]
    weighty = lambda f: F.concat(F.slice(f, 1, 4), F.filter(f, lambda x: (F.length(x["x"]) >= 12) & any_of(x)))
    parts = lambda f: F.struct(T.unique_ci(F.transform(weighty(f), lambda x: x["x"]), 8).alias("summary"), picked(f, "decision", "x", 10).alias("decisions"), picked(f, "action", "x", 16).alias("actions"), picked(f, "question", "x", 10).alias("questions"), picked(f, "risk", "x", 10).alias("risks"))
    marked = F.filter(flags, lambda x: any_of(x) | (x["i"] < 4))
    out = rows.select(key, "norm", T.bind(marked, parts).alias("p"), T.clamp_head_tail(F.col("norm"), int(most_chars * 0.45)).alias("carry")).select(key, "norm", "p.*", "carry")
    listed = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    part = lambda title, name: F.when(F.size(name) > 0, F.concat(F.lit(title + ":\n"), listed(F.col(name))))
    compact = F.concat_ws(
        "\n\n", F.lit(f"Purpose: {purpose}"), F.concat(F.lit("Summary:\n"), F.when(F.size("summary") > 0, listed(F.col("summary"))).otherwise("- No strong summary lines detected.")),
        part("Decisions", "decisions"), part("Action items", "actions"), part("Open questions", "questions"), part("Risks / blockers", "risks"), F.concat(F.lit("Carry-forward context:\n"), "carry"),
    )
    out = out.withColumn("compact", T.clamp_head_tail(compact, most_chars))
    raw, small = T.estimate_tokens("norm"), T.estimate_tokens("compact")
    saved, pct = T.savings(raw, small)
    return out.select(key, "summary", "decisions", "actions", "questions", "risks", "carry", "compact", raw.alias("raw_tokens"), small.alias("compact_tokens"), saved.alias("saved_tokens"), pct.alias("savings_pct"))


def units_of(text: Column) -> Column:
    """Paragraphs if there are four or more, else lines; trimmed, none empty."""
    clean = lambda parts: F.filter(F.transform(parts, T.trim), lambda x: x != "")
    return T.bind(clean(F.split(text, "\n{2,}")), lambda p: F.when(F.size(p) >= 4, p).otherwise(clean(F.split(text, "\n"))))


def score_unit(unit: Column, index: Column, query_terms: tuple[str, ...], lowered: Column | None = None) -> Column:
    """Query hits, weighted patterns, and a bonus for early units. A unit that has a term as a word also has it as a part."""
    score, lowered = F.greatest(F.lit(0.0), 2 - index * 0.05), F.lower(unit) if lowered is None else lowered
    if query_terms:
        hits = sum(lowered.contains(t).cast("int") for t in query_terms)
        score = score + T.bind(hits, lambda h: 8 * h + F.when(h >= 2, 8).otherwise(0))
    for pattern, weight in P.UNIT_SCORES:
        score = score + F.when(P.matches(unit, pattern, lowered), weight).otherwise(0)
    return score


#: Kept places are gathered in lists of this length, so that adding one does not copy them all.
PLACES = 256


def compress(docs: DataFrame, query_terms: tuple[str, ...] = (), ratio: float = 0.35, key: str = "doc_id", most_input: int | None = None) -> DataFrame:
    """Extractive compression under a token budget.

    Units go by score, then place. One that does not fit is passed over, not the end: a critical one may
    exceed the budget while less than 1.25 of it is used, and the first is always taken. The fold stops
    at the budget. Kept units are put back in their order.
    """
    ratio = min(0.9, max(0.1, ratio))
    norm = F.coalesce("text", F.lit(""))
    rows = spread(docs.select(key, "text")).select(key, (F.substring(norm, 1, most_input) if most_input else norm).alias("norm"))
    rows = rows.withColumns({"raw_tokens": T.estimate_tokens("norm")}).withColumn("target", F.greatest(F.lit(32).cast("long"), F.floor(F.col("raw_tokens") * ratio)))
    unit = lambda x, i: T.bind(F.lower(x), lambda low: F.struct((-score_unit(x, i, query_terms, low)).alias("cost"), i.alias("index"), T.estimate_tokens(x).alias("tokens"), P.matches(x, P.CRITICAL, low).alias("critical"), P.matches(x, P.NOISE, low).alias("noise"), x.alias("unit")))
    rows = rows.select(key, "raw_tokens", "target", F.transform(units_of(F.col("norm")), unit).alias("units"))
    places = lambda x: x.cast("array<int>")
    start = F.struct(F.lit(0).cast("long").alias("tokens"), F.lit(False).alias("done"), F.lit(False).alias("any"), F.array().cast("array<array<int>>").alias("full"), places(F.array()).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        over = acc["any"] & (acc["tokens"] + x["tokens"] > F.col("target")) & ~(x["critical"] & (acc["tokens"] < F.ceil(F.col("target") * 1.25)))
        skip = acc["done"] | x["noise"] | (x["cost"] >= 0) | over
        total, ends = acc["tokens"] + x["tokens"], F.size(acc["kept"]) == PLACES
        full = F.when(ends, F.concat(acc["full"], F.array(acc["kept"]))).otherwise(acc["full"])
        kept = F.when(ends, F.array(x["index"])).otherwise(F.concat(acc["kept"], F.array(x["index"])))
        return F.when(skip, acc).otherwise(F.struct(total.alias("tokens"), (total >= F.col("target")).alias("done"), F.lit(True).alias("any"), full.alias("full"), kept.alias("kept")))

    ranked = F.array_sort(F.transform("units", lambda x: x.dropFields("unit")))
    first = lambda r: places(F.transform(F.slice(r, 1, 1), lambda x: x["index"]))
    kept = T.bind(ranked, lambda r: F.aggregate(r, start, step, lambda acc: F.when(acc["any"], F.concat(F.flatten(acc["full"]), acc["kept"])).otherwise(first(r))))
    chosen = T.bind(F.col("units"), lambda u: F.transform(F.array_sort(kept), lambda i: F.get(u, i)))
    counts = lambda c: F.struct(F.size(c).alias("units_kept"), F.size(F.filter(c, lambda x: x["critical"])).alias("critical_kept"), F.array_join(F.transform(c, lambda x: x["unit"]), "\n\n").alias("compact"))
    rows = rows.select(key, "raw_tokens", F.size("units").alias("units_total"), T.bind(chosen, counts).alias("c")).select(key, "raw_tokens", "units_total", "c.*")
    small = T.estimate_tokens("compact")
    saved, pct = T.savings(F.col("raw_tokens"), small)
    return rows.select(key, "units_total", "units_kept", "critical_kept", "raw_tokens", small.alias("compact_tokens"), saved.alias("saved_tokens"), pct.alias("savings_pct"), "compact")


# --- repeated blocks --------------------------------------------------------------------------


def normal_line(text: Column) -> Column:
    """For comparing: collapsed white space; braces and comment lines count as empty."""
    out = T.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(out.rlike(r"^(?:[{}()\[\];,]+|//.*|/\*.*|\*.*|#.*)$"), "").otherwise(out)


def duplicate_blocks(docs: DataFrame, size: int = 6, least_chars: int = 80, key: str = "doc_id") -> DataFrame:
    """Blocks of `size` non-empty lines that more than one document has: hash, documents, occurrences, first place.

    The window is made inside each document's line array, so only hashes are shuffled.
    """
    clean = F.filter(F.transform(T.lines_of(F.coalesce("text", F.lit(""))), lambda x, i: F.struct(normal_line(x).alias("x"), (i + 1).alias("line"))), lambda p: p["x"] != "")
    rows = spread(docs.select(key, "text")).select(key, clean.alias("l")).filter(F.size("l") >= size)
    fits = lambda b, text: (F.size(F.array_distinct(b)) >= min(3, size)) & (F.length(text) >= least_chars)
    made = lambda l, i, b: T.bind(F.array_join(b, "\n"), lambda text: F.when(fits(b, text), F.struct(T.stable_hash(text).alias("hash"), F.element_at(l, i)["line"].alias("line"))))
    every = lambda l, x: F.transform(F.sequence(F.lit(1), F.size(l) - (size - 1)), lambda i: T.bind(F.slice(x, i, size), lambda b: made(l, i, b)))
    blocks = rows.select(key, F.explode(T.bind(F.col("l"), lambda l: T.bind(F.transform(l, lambda p: p["x"]), lambda x: F.array_compact(every(l, x))))).alias("b"))
    # a first step by (hash, document), so that a block of very many documents stays small before it is counted
    per = blocks.groupBy(F.col("b.hash").alias("hash"), key).agg(F.count("*").alias("n"), F.min("b.line").alias("line"))
    return per.groupBy("hash").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"), F.min(F.struct(key, "line")).alias("first")).filter("documents > 1").select("hash", "documents", "occurrences", F.col(f"first.{key}").alias("first_doc"), F.col("first.line").alias("first_line"))


# --- compressors and their statistics -----------------------------------------------------------

COMPRESSORS = {
    "first200": lambda x: F.substring(x, 1, 200),
    "first1k": lambda x: F.substring(x, 1, 1000),
    "passthrough": lambda x: x,
    "ws_collapse": lambda x: F.regexp_replace(x, r"\s+", " "),
}


def compressor_runs(fixtures: DataFrame, runs: int = 2, key: str = "doc_id") -> DataFrame:
    """(compressor, sample_id, run, input_size, output_size, ratio, b, md5) of each compressor on each fixture, repeated."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("compressor"), f(F.coalesce("text", F.lit(""))).alias("out")) for n, f in COMPRESSORS.items())))
    rows = fixtures.select(key, F.length(F.coalesce("text", F.lit(""))).alias("input_size"), each.alias("c"))
    rows = rows.select(key, "input_size", "c.*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    ratio = F.when(F.col("input_size") > 0, F.length("out") / F.col("input_size")).otherwise(0.0)
    return rows.select("compressor", key, F.concat(F.col(key).cast("string"), F.lit("#r"), F.col("run").cast("string")).alias("sample_id"), "run", "input_size", F.length("out").alias("output_size"), ratio.alias("ratio"), (1 - ratio).alias("b"), F.md5("out").alias("md5"))


def aggregate_compression(runs: DataFrame, keys: list[str], most_cv: float = 0.05, most_ratio: float = 0.70) -> DataFrame:
    """n, mean, sample deviation, cv, extremes and verdict of the ratios of each group."""
    out = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ratio").alias("mean"), F.coalesce(F.when(F.count("*") > 1, F.stddev_samp("ratio")), F.lit(0.0)).alias("stdev"), F.min("ratio").alias("least"), F.max("ratio").alias("most"))
    cv = F.when(F.col("mean") > 0, F.col("stdev") / F.col("mean")).otherwise(0.0)
    return out.withColumn("cv", cv).withColumn("verdict", F.when(F.col("cv") > most_cv, "FAIL_STOCHASTIC").when(F.col("mean") > most_ratio, "FAIL_NO_SAVING").otherwise("PASS"))


def sample_group(sample_id: Column) -> Column:
    return F.coalesce(F.substring_index(sample_id, "#", 1), F.lit("unknown"))


def corpus_report(per_fixture: DataFrame) -> DataFrame:
    """Mean and median of the fixtures' means, and the share that passes, per compressor."""
    return per_fixture.groupBy("compressor").agg(F.count("*").alias("fixtures"), F.avg("mean").alias("mean_of_means"), F.median("mean").alias("median_of_means"), F.avg((F.col("verdict") == "PASS").cast("double")).alias("pass_rate"))


def stability(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct output digests over the runs of a fixture; stable if there is one. Groups of one run are left out."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("md5").alias("unique_md5"), F.min_by("md5", "run").alias("first_md5")).filter("n >= 2").withColumn("stable", F.col("unique_md5") == 1)


def windowed_context(docs: DataFrame, term: str, around: int = 3, top: int = 3, key: str = "doc_id") -> DataFrame:
    """The first `top` lines with a term, each with the lines around it."""
    l = F.col("l")
    rows = docs.select(key, T.lines_of(F.coalesce("text", F.lit(""))).alias("l"))
    hits = F.slice(F.filter(F.transform(l, lambda x, i: F.when(F.lower(x).contains(term), i + 1)), lambda i: i.isNotNull()), 1, top)
    rows = rows.select(key, "l", F.posexplode(hits).alias("n", "line"))
    low = F.greatest(F.lit(1), F.col("line") - around)
    return rows.select(key, (F.col("n") + 1).alias("rank"), "line", F.array_join(F.slice(l, low, F.col("line") + around - low + 1), "\n").alias("context"))


def merged_ranges(docs: DataFrame, pattern: str, around: int = 3, key: str = "doc_id") -> DataFrame:
    """Ranges of lines around each match, merged where they touch."""
    found = lines(docs.select(key, F.coalesce("text", F.lit("")).alias("text")), key).filter(P.matches(F.col("text"), pattern))
    size = docs.select(key, F.size(T.lines_of(F.coalesce("text", F.lit("")))).alias("n"))
    spans = found.join(size, key).select(key, F.greatest(F.lit(1), F.col("line") - around).alias("s"), F.least("n", F.col("line") + around).alias("e"), "line")
    w = Window.partitionBy(key).orderBy("line")
    new = F.coalesce(F.col("s") > F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    return spans.withColumn("new", new.cast("int")).withColumn("range", F.sum("new").over(w)).groupBy(key, "range").agg(F.min("s").alias("start_line"), F.max("e").alias("end_line"), F.count("*").alias("matches"))
