"""What became of reading a web page: kinds of problems, shells without text, facts, uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators.html_tree import elements, main_parts

# Patterns, in the order in which they are tried.
FACT = r"(?iu)\d{2,}|[$€£₽%]|pricing|price|deadline|date|api|token|limit|latency|cost|стоим|цена|лимит|дата"
SHELL = "(?i)__NEXT_DATA__|data-reactroot|vite|webpackJsonp|enable javascript|cf-chl|cloudflare|datadome|turnstile|captcha"
SHELL_CHARS, LEAST_TEXT, LOW_TEXT = 50_000, 800, 400
BEFORE_STATUS = [
    ("key missing|key is not configured|not configured", "scraper_core_key_missing"),
    ("fallback is disabled|fallback_disabled", "scraper_core_disabled"),
    ("likely_js_or_challenge_shell|cloudflare|captcha|turnstile|challenge", "local_js_or_challenge"),
    ("low_text_extraction_volume", "local_low_extraction"),
]
LATE = "abort|timeout|timed out"
AFTER_STATUS = [
    ("weak_extraction|large_html_tiny_extraction|diagnostic_text_instead_of_content", "scraper_core_weak_extraction"),
    ("scraper_core_empty_markdown", "scraper_core_empty"),
    ("scraper_core_failed|scraper-core fallback failed", "scraper_core_failed"),
]
WEAK_WARNINGS = "low_text_extraction_volume|likely_js_or_challenge_shell|weak_extraction"
BODY_SHARE = 0.62


def url_issue(message: Column, reason: Column) -> Column:
    """The kind of problem that a message and a fallback reason tell of; none for neither."""
    text = F.lower(F.concat(F.coalesce(reason, F.lit("")), F.lit(" "), F.coalesce(message, F.lit(""))))
    status = F.regexp_extract(text, r"http\s+(\d{3})", 1).try_cast("int")
    remote = lambda name: F.concat(F.when(text.contains("scraper-core") | text.contains("scraper_core"), "scraper_core").otherwise("local"), F.lit(name))
    out = F.when(F.lit(False), "")
    for pattern, name in BEFORE_STATUS:
        out = out.when(text.rlike(pattern), name)
    out = out.when(text.rlike(LATE), F.when(text.contains("scraper"), "scraper_core_timeout").otherwise("local_timeout"))
    out = out.when(status == 403, remote("_http_403")).when(status >= 500, remote("_http_5xx")).when(status >= 400, remote("_http_4xx"))
    for pattern, name in AFTER_STATUS:
        out = out.when(text.rlike(pattern), name)
    return out.when((F.coalesce(reason, F.lit("")) != "") | (F.coalesce(message, F.lit("")) != ""), "unknown").otherwise("none")


def extract_facts(text: Column, most: int = 18) -> Column:
    """Lines with numbers, prices, dates, limits: each once, the first ones."""
    return T.unique_ci(F.filter(F.transform(F.split(text, "\n"), T.trim), lambda x: x.rlike(FACT)), most)


def is_script_shell(html: Column, text: Column) -> Column:
    """A page with little text whose beginning has marks of a page that scripts build. Only the beginning is where such marks are."""
    return (F.length(text) < LEAST_TEXT) & F.substring(html, 1, SHELL_CHARS).rlike(SHELL)


def url_uncertainty(warnings: Column, fallback: Column) -> Column:
    weak = F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: w.rlike(WEAK_WARNINGS))
    return F.when(weak, 0.05).when(F.coalesce(fallback, F.lit(False)), 0.025).otherwise(0.02)


def prepared_pages(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", purpose: str = "", most_chars: int = 8000) -> DataFrame:
    """key, title, description, canonical, headings, links, facts, text, body, markdown, warnings, uncertainty of web pages.

    The text is that of the page's main element without navigation, headers, footers, forms and hidden parts; the
    first `BODY_SHARE` of the budget is body. A null page has no text and two warnings.
    """
    raw = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    shell = F.coalesce(F.substring("html", 1, SHELL_CHARS), F.lit("")).rlike(SHELL)
    found = main_parts(elements(raw.withColumn("key", F.struct("key", shell.alias("marks"))), "key"))
    text = F.col("text")
    found = found.withColumn("facts", extract_facts(text)).withColumn("body", T.clamp_head_tail(text, int(most_chars * BODY_SHARE)))
    low, script = F.length(text) < LOW_TEXT, F.col("key.marks") & (F.length(text) < LEAST_TEXT)
    warnings = F.filter(F.array(F.when(low, F.lit("low_text_extraction_volume")), F.when(script, F.lit("likely_js_or_challenge_shell"))), lambda x: x.isNotNull())
    listed = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(items, "\n")))
    dashed = lambda column: F.transform(column, lambda x: F.concat(F.lit("- "), x))
    links = F.transform(F.slice("links", 1, 20), lambda x: F.concat(F.lit("- ["), x["text"], F.lit("]("), x["url"], F.lit(")")))
    sections = (
        F.concat(F.lit("# "), F.col("title")), F.concat(F.lit("Source: "), F.col("url")), F.lit(f"Purpose: {purpose}") if purpose else F.lit(None).cast("string"), F.concat(F.lit("Description: "), F.col("description")),
        listed("Headings", dashed(F.col("headings"))), listed("Key facts", dashed(F.col("facts"))), F.concat(F.lit("Main content:\n"), F.col("body")), listed("Key links", links),
    )
    found = found.withColumns({"warnings": warnings, "markdown": F.concat_ws("\n\n", *sections)}).withColumn("uncertainty", url_uncertainty(F.col("warnings"), F.lit(False)))
    return found.select(F.col("key.key").alias(key), "url", "title", "description", "canonical", "headings", "links", "facts", "text", "body", "markdown", "warnings", "uncertainty")
