"""Search terms for notes about a page element, and what a note found by them warns of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as T

# What else to look for, by the kind of element and by words of a comment.
ELEMENTS = {
    "video player": ("video", "media", "player", "overflow", "padding", "responsive"),
    "chart": ("chart", "graph", "visualization", "d3", "recharts", "data"),
    "address bar": ("url", "navigation", "routing", "browser", "location"),
    "button": ("button", "click", "cta", "action", "disabled"),
    "heading": ("heading", "title", "h1", "h2", "typography"),
    "input": ("input", "form", "validation", "field"),
    "image": ("image", "img", "lazy", "loading", "optimization"),
    "container": ("container", "layout", "grid", "flex", "css"),
    "navigation": ("nav", "menu", "navbar", "sidebar"),
}
COMMENTS = {
    "padding": ("padding", "margin", "spacing", "layout", "css"),
    "mobile": ("mobile", "responsive", "breakpoint", "device"),
    "slow": ("performance", "loading", "speed", "optimization"),
    "text": ("text", "font", "typography", "i18n", "translation"),
}
SKIPPED = ("the", "and", "for", "this", "with")
MOST_TERMS, MOST_WORDS, AROUND = 10, 5, 3
WARNING = r"(?i)^\s*[-*]\s*(?:⚠️|❌|WARNING|GOTCHA|BUG)"


def search_terms(element: Column, comment: Column) -> Column:
    """At most ten terms: those of the element, those of the comment's subjects, the comment's first words."""
    e, c = F.lower(F.coalesce(element, F.lit(""))), F.lower(F.coalesce(comment, F.lit("")))
    none = F.array().cast("array<string>")
    parts = [F.when(x.contains(k), F.array(*map(F.lit, v))).otherwise(none) for x, table in ((e, ELEMENTS), (c, COMMENTS)) for k, v in table.items()]
    words = F.filter(F.split(c, r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*SKIPPED))
    return F.slice(F.array_distinct(F.concat(*parts, F.slice(words, 1, MOST_WORDS))), 1, MOST_TERMS)


def gotchas(notes: DataFrame, terms: list[str], key: str = "path", text: str = "text") -> DataFrame:
    """(key, term, line, title, description, category, severity) of each line of a note that has a term, from the lines around it.

    The last heading, the last warning and the last subject of these lines count.
    """
    rows = notes.select(key, T.lines_of(F.coalesce(text, F.lit(""))).alias("l"))
    found = rows.select(key, "l", F.explode(F.array(*map(F.lit, terms))).alias("term"))
    at = F.filter(F.transform("l", lambda x, i: F.when(F.lower(x).contains(F.lower(F.col("term"))), i + 1)), lambda i: i.isNotNull())
    found = found.select(key, "l", "term", F.explode(at).alias("line"))
    low = F.greatest(F.lit(1), F.col("line") - AROUND)
    found = found.select(key, "term", "line", F.slice("l", low, F.col("line") + AROUND - low + 1).alias("c"))
    heading, warns = lambda x: x.startswith("## ") | x.startswith("### "), lambda x: x.rlike(WARNING)
    last = lambda f: F.element_at(F.filter("c", f), -1)
    plain = lambda x: ~heading(x) & ~warns(x)
    style = lambda x: F.lower(x).contains("css") | F.lower(x).contains("layout")
    subject = lambda x: plain(x) & (style(x) | F.lower(x).contains("performance"))
    some = lambda f: F.size(F.filter("c", f)) > 0
    title = F.when(some(heading), F.trim(F.regexp_replace(last(heading), r"^#+\s+", ""))).otherwise(F.concat(F.lit('Issue related to "'), "term", F.lit('"')))
    warning = F.trim(F.regexp_replace(last(warns), r"^\s*[-*]\s*", ""))
    described = F.when(some(warns), warning).otherwise(F.concat(F.substring(F.array_join("c", "\n"), 1, 200), F.lit("...")))
    category = F.when(some(subject), F.when(style(last(subject)), "css").otherwise("performance")).otherwise("general")
    severity = F.when(some(warns), F.when(last(warns).contains("⚠️") | last(warns).contains("❌"), "high").otherwise("medium")).otherwise("medium")
    return found.select(key, "term", "line", title.alias("title"), described.alias("description"), category.alias("category"), severity.alias("severity"))
