"""Explainable ranked retrieval over files (path, text): path, content, hints and recency add up."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import predicates as P
from strataloom.functions.text import extension, lines_of, round_to

MOST_TERMS, MOST_LINES = 24, 12
HINT_WEIGHTS = {"explicit": 90, "changed": 70, "symbol": 60, "recent": 32, "related": 18}  # fixed


def variants(term: str) -> list[str]:
    """A term and its stems."""
    low, out = term.lower(), [term]
    if re.fullmatch("[a-z]+", low):
        if low.endswith("ing") and len(low) > 5:
            stem = low[:-3]
            out.append(stem)
            if len(stem) > 2 and stem[-1] == stem[-2]:
                out.append(stem[:-1])
        for end, least, by in (("er", 5, ""), ("ies", 5, "y"), ("s", 4, "")):
            if low.endswith(end) and len(low) > least:
                out.append(low[: -len(end)] + by)
    return [x for x in dict.fromkeys(out) if len(x) >= 2]


def query_terms(query: str) -> list[str]:
    """Identifiers, their parts, and words of a query literal, with their variants; the first 24."""
    exact = re.findall(r"[A-Za-z_$][A-Za-z0-9_$:./-]{2,}|[Ѐ-ӿ]{3,}", query)
    parts = [y for x in exact for y in [x, *(p for p in re.split(r"[^A-Za-z0-9_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", x)) if len(p) >= 2)]]
    words = [x for x in re.split(r"[^a-z0-9_Ѐ-ӿ]+", query.lower()) if len(x) >= 3]
    return [v for x in dict.fromkeys([*parts, *words]) for v in variants(x)][:MOST_TERMS]


def compounds(a: str, b: str) -> list[str]:
    """kebab, snake, camel and Pascal forms of two neighbouring terms."""
    a, b = a.lower(), b.lower()
    return [f"{a}-{b}", f"{a}_{b}", a + b.capitalize(), a.capitalize() + b.capitalize()]


def plans(terms: list[str]) -> list[tuple[str, int, list[str]]]:
    """(name, boost, terms) of the plans: as asked, expanded by compounds, quoted."""
    wide = list(dict.fromkeys([*terms, *(x for a, b in zip(terms, terms[1:]) for x in compounds(a, b))]))[:18]
    return [("lexical", 0, terms[:18]), ("expanded", 6, wide), ("quoted", 8, [" ".join(terms[:2])] if len(terms) > 1 else [])]


def path_score(path: Column, terms: list[str], intent: str = "code") -> Column:
    low = F.lower(path)
    base = F.element_at(F.split(low, "/"), -1)
    score = F.lit(0)
    for t in terms:
        score = score + F.when(base.contains(t.lower()), 12).when(low.contains(t.lower()), 6).otherwise(0)
    score = score + F.when(extension(path).isin(*P.CODE_EXTENSIONS), 2).otherwise(0)
    test = low.rlike(r"(^|/)(__tests__|tests?|specs?)(/|$)|\.(test|spec)\.[tj]sx?$")
    score = score + F.when(test, 12 if intent == "test" else -1).otherwise(0)
    if intent == "docs":
        score = score + F.when(low.rlike(r"\.(md|mdx|txt)$"), 10).otherwise(0)
    return score


def content_matches(files: DataFrame, query_plans: list[tuple[str, int, list[str]]], most_lines: int | None = MOST_LINES) -> DataFrame:
    """Per file: matched lines (each plan counts its first `most_lines`, all for None), and the content score.

    One pass over the lines serves all plans.
    """
    l = F.transform(lines_of(F.col("text")), F.lower)
    rows = files.select("path", l.alias("l"))
    rows = rows.select("path", *(_first_lines_with(own, most_lines).alias(f"at_{name}") for name, _, own in query_plans))
    every = F.array_sort(F.array_distinct(F.concat(*(F.col(f"at_{n}") for n, _, _ in query_plans))))
    boost = sum(F.when(F.size(f"at_{n}") > 0, b).otherwise(0) for n, b, _ in query_plans)
    return content_score(rows.select("path", every.alias("lines"), boost.alias("boost")).filter(F.size("lines") > 0))


def capped(lines: Column, boost: Column) -> Column:
    """Ten a line and the plans' boosts, each up to its limit."""
    return F.least(F.lit(80), lines * 10) + F.least(F.lit(24), boost)


def content_score(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content_score", capped(F.size("lines"), F.col("boost")))


def _first_lines_with(own: list[str], most: int | None) -> Column:
    """Numbers of the first lines that hold one of the terms."""
    if not own:
        return F.array().cast("array<int>")
    found = F.filter(F.transform("l", lambda x, i: F.when(_any(x, own), i + 1)), lambda i: i.isNotNull())
    return found if most is None else F.slice(found, 1, most)


def _any(x: Column, own: list[str]) -> Column:
    out = F.lit(False)
    for t in own:
        out = out | x.contains(t.lower())
    return out


def hint_scores(hints: DataFrame) -> DataFrame:
    """(path, kind) to a boost: each kind once, 120 at most; the kinds' table is five rows."""
    weight = F.create_map(*(x for k, v in HINT_WEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    return hints.distinct().groupBy("path").agg(F.least(F.lit(120), F.sum(F.coalesce(F.try_element_at(weight, F.col("kind")), F.lit(0)))).alias("hint_score"))


def with_parts(files: DataFrame, hints: DataFrame | None, changed: DataFrame | None) -> DataFrame:
    """files (path, chars, path_score and more) with hint_score, changed_score and the score without content."""
    for column, other in (("hint_score", None if hints is None else hint_scores(hints)), ("changed_score", None if changed is None else changed.select("path").distinct().withColumn("changed_score", F.lit(8)))):
        files = files.withColumn(column, F.lit(0)) if other is None else files.join(other, "path", "left").withColumn(column, F.coalesce(column, F.lit(0)))
    # a size penalty for what would otherwise come first, by a deterministic order
    penalty = F.when(F.col("chars") > 120_000, 20).when(F.col("chars") > 40_000, 6).otherwise(0)
    return files.withColumn("score", F.col("path_score") + F.col("hint_score") + F.col("changed_score") - penalty)


def best(files: DataFrame, content: DataFrame, top: int) -> DataFrame:
    """The best of files with_parts and their content matches; ties by path."""
    out = files.join(content, "path", "left").withColumns({"content_score": F.coalesce("content_score", F.lit(0)), "lines": F.coalesce("lines", F.array().cast("array<int>"))})
    scored = out.select("path", "path_score", "content_score", "hint_score", "changed_score", "lines", (F.col("score") + F.col("content_score")).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "path").limit(top)


def rank_files(
    files: DataFrame, query: str, hints: DataFrame | None = None, changed: DataFrame | None = None, intent: str = "code", top: int = 12, most_lines: int | None = MOST_LINES
) -> DataFrame:
    """The best files: path, score, its parts, matched lines; ties by path. It reads all texts: text_index does not."""
    terms = query_terms(query)
    rows = files.filter(P.filter_reason(F.col("path")).isNull()).select("path", path_score(F.col("path"), terms, intent).alias("path_score"), F.length("text").alias("chars"))
    return best(with_parts(rows, hints, changed), content_matches(files, plans(terms), most_lines), top)


def confidence(ranked: DataFrame, snippets: Column | None = None) -> DataFrame:
    """One row: uncertainty of the ranked files (few rows), from the top score, the gap behind it, and coverage."""
    w = Window.orderBy(F.desc("score"), "path")
    top = ranked.withColumns({"r": F.row_number().over(w), "second": F.lead("score", 1, 0).over(w)})
    a = top.agg(F.count("*").alias("files"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("r") == 1, F.col("score") - F.col("second"))).alias("gap"), F.sum((F.size("lines") > 0).cast("int")).alias("snippets"))
    u = F.lit(0.05) + F.when(F.col("top") >= 60, -0.04).when(F.col("top") < 25, 0.13).otherwise(0.0) + F.when((F.col("gap") < 8) & (F.col("files") > 3), 0.06).otherwise(0.0) + F.when(F.col("snippets") < 3, 0.06).otherwise(0.0)
    bounded = F.greatest(F.lit(0.01), F.least(F.lit(0.5), round_to(u, 2)))
    return a.select("files", "top", "gap", F.coalesce("snippets", F.lit(0)).alias("snippets"), F.when(F.coalesce(F.col("snippets"), F.lit(0)) == 0, 0.42).otherwise(bounded).alias("uncertainty"))


def path_priority(path: Column) -> Column:
    """For maps of a repository: entry points, docs and sources first, deep paths last."""
    low, depth = F.lower(path), F.size(F.split(path, "/")) - 1
    base = F.element_at(F.split(low, "/"), -1)
    score = F.when(base.isin("readme.md", "package.json", "pyproject.toml"), 80).otherwise(0) + F.when(base.rlike(r"^(index|main|app|server)\."), 36).otherwise(0) + F.when(low.rlike(r"(^|/)src/"), 24).otherwise(0) + F.when(low.rlike(r"(^|/)docs?/"), 8).otherwise(0)
    return score - 2 * depth


def top_per_group(files: DataFrame, group: Column, order: list, top: int = 18) -> DataFrame:
    w = Window.partitionBy("group").orderBy(*order)
    return files.withColumn("group", group).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


#: What else to search for when a query speaks of a subject; several words of one set stand for each other. A default: give your own subjects.
EXPANSIONS = [
    ((("mcp",),), ("tools/list", "CallToolRequestSchema")),
    ((("api", "route", "endpoint"),), ("/api/", "route", "endpoint")),
    ((("screenshot", "screenshots"),), ("prepare_screenshot", "image_urls_for_model")),
    ((("retrieval", "retrieve"),), ("retrieve_context", "find_files", "raw_search")),
    ((("context",), ("prep", "prepare")), ("prep_logs", "prep_url", "prep_text")),
]
TEST_EXPANSION = (".test.", ".spec.", "describe(", "it(")
MOST_SYMBOL_SCORE = 60


def domain_expansion(terms: Column, intent: str = "code", most: int = 18, expansions: list = EXPANSIONS) -> Column:
    """Further terms of the subjects that a query's terms name; expansions: (sets of words, terms to add) of each subject."""
    low = F.transform(terms, F.lower)
    none = F.array().cast("array<string>")
    parts = []
    for needs, adds in expansions:
        fits = F.lit(True)
        for words in needs:
            fits = fits & F.arrays_overlap(low, F.array(*map(F.lit, words)))
        parts.append(F.when(fits, F.array(*map(F.lit, adds))).otherwise(none))
    if intent == "test":
        parts.append(F.array(*map(F.lit, TEST_EXPANSION)))
    return F.slice(F.array_distinct(F.concat(*parts)), 1, most)


def symbol_score(symbols: DataFrame, imports: DataFrame, terms: list[str]) -> DataFrame:
    """(path, score): for each term 14 a symbol with it in the name (18 a route or tool), 4 a signature, 3 an import target; at most 60."""
    name, signature, target = F.lower("name"), F.lower(F.coalesce("signature", F.lit(""))), F.lower("target")
    of_symbol, of_import = F.lit(0), F.lit(0)
    for t in (x.lower() for x in terms):
        of_symbol = of_symbol + F.when(name.contains(t), F.when(F.col("kind").isin("route", "tool"), 18).otherwise(14)).when(signature.contains(t), 4).otherwise(0)
        of_import = of_import + F.when(target.contains(t), 3).otherwise(0)
    both = symbols.select("path", of_symbol.alias("s")).unionByName(imports.select("path", of_import.alias("s")))
    return both.groupBy("path").agg(F.least(F.lit(MOST_SYMBOL_SCORE), F.sum("s")).alias("score"))


def by_tier(ranked: DataFrame, tier: str, rank: str) -> DataFrame:
    """Rows with their place when tiers go first and the earlier rank stays the order inside a tier."""
    counts = ranked.groupBy(tier).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(tier).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a tier
    w = Window.partitionBy(tier).orderBy(rank)
    return ranked.join(F.broadcast(before), tier).withColumn("place", F.row_number().over(w) + F.col("_before")).drop("_n", "_before")


def variants_of(term: Column) -> Column:
    """A term and its stems, for a column of terms; the same rules as for one query's."""
    low = F.lower(term)
    n = F.length(low)
    cut = lambda k, by="": F.concat(F.substr(low, F.lit(1), n - k), F.lit(by))
    ing, double = low.endswith("ing") & (n > 5), F.substr(low, n - 3, F.lit(1)) == F.substr(low, n - 4, F.lit(1))
    found = F.array(term, F.when(ing, cut(3)), F.when(ing & double & (n > 5), cut(4)), F.when(low.endswith("er") & (n > 5), cut(2)), F.when(low.endswith("ies") & (n > 5), cut(3, "y")), F.when(low.endswith("s") & (n > 4), cut(1)))
    return F.when(low.rlike("^[a-z]+$"), F.array_distinct(F.filter(F.array_compact(found), lambda x: F.length(x) >= 2))).otherwise(F.array(term))


def compounds_of(a: Column, b: Column) -> Column:
    """kebab, snake, camel and Pascal forms of two terms."""
    a, b = F.lower(a), F.lower(b)
    capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))
    return F.array(F.concat_ws("-", a, b), F.concat_ws("_", a, b), F.concat(a, capital(b)), F.concat(capital(a), capital(b)))


def query_terms_of(query: Column, most: int = MOST_TERMS) -> Column:
    """The terms of each query of a column, by the rules of query_terms (a small helper on Arrow batches)."""
    return F.pandas_udf(lambda s: s.map(lambda x: query_terms(x or "")[:most]), "array<string>")(query)
