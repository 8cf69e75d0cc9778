"""Column builders over text: token estimates, rounding, clamping, white space, hashing, slugs, redaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
BLANKS = " \t\n\x0b\f\r\u00a0\ufeff"
ANSI = r"[\u001b\u009b][\[\]()#;?]*(?:(?:(?:[a-zA-Z\d]*(?:;[a-zA-Z\d]*)*)?\u0007)|(?:(?:\d{1,4}(?:;\d{0,4})*)?[\dA-PR-TZcf-nq-uy=><~]))"
CYRILLIC = "[А-Яа-яЁё]"
SECRETS = (
    (r"(?i)(authorization:\s*bearer\s+)\S+", "$1[redacted]"),
    (r"(?i)((?:api[_-]?key|token|secret|password|passwd)\s*[:=]\s*)\S+", "$1[redacted]"),
    (r"\b(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{12,}", "[redacted]"),
)
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "you", "your", "are", "или", "для", "что", "это", "как", "при", "без", "его", "она", "они")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_to(x: Column, digits: int = 0) -> Column:
    """Half toward plus infinity, as a double."""
    factor = float(10**digits)
    return F.floor(x * factor + 0.5) / F.lit(factor)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it, also inside the lambdas of f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def estimate_tokens(text: str | Column) -> Column:
    """Characters by 4, or by 3.2 where more than a quarter of them are Cyrillic."""
    t = F.coalesce(col(text), F.lit(""))
    n = F.length(t)
    by = F.when(F.octet_length(t) == n, 4.0).when(F.regexp_count(t, F.lit(CYRILLIC)) > n * 0.25, 3.2).otherwise(4.0)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / by))).cast("long")


def estimate_tokens_mixed(text: str | Column) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    cyr = F.regexp_count(t, F.lit(CYRILLIC))
    return F.greatest(F.lit(1), F.ceil(cyr / 2.5 + (F.length(t) - cyr) / 4.0)).cast("long")


def estimate_tokens_flat(text: str | Column) -> Column:
    return F.ceil(F.length(F.coalesce(col(text), F.lit(""))) / 4.0).cast("long")


def estimate_image_tokens(width: Column, height: Column) -> tuple[Column, Column]:
    """By area, and by tiles of 512 pixels."""
    tiles = F.ceil(width / 512.0) * F.ceil(height / 512.0)
    return F.ceil(width * height / 750.0).cast("long"), (85 + 170 * tiles).cast("long")


def savings(raw: Column, compact: Column) -> tuple[Column, Column]:
    """Saved tokens and per cent to one digit."""
    saved = F.greatest(F.lit(0).cast("long"), raw - compact)
    return saved, F.when(raw > 0, round_to(saved / raw * 100.0, 1)).otherwise(0.0)


def savings_pct(raw: Column, compact: Column) -> Column:
    return F.when(raw > 0, F.greatest(F.lit(0.0), round_to((1.0 - compact / raw) * 100.0, 1))).otherwise(0.0)


def trim(text: Column) -> Column:
    """All white space at both ends, not only blanks."""
    return F.btrim(text, F.lit(BLANKS))


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def trim_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def clamp_head_tail(text: Column, most: int) -> Column:
    """72 per cent from the head and 18 from the tail of a longer text, with a count of what is left out."""
    n = F.length(text)
    head = trim_end(F.substring(text, 1, int(most * 0.72 + 1e-9)))
    tail = trim_start(F.right(text, F.lit(int(most * 0.18 + 1e-9))))
    left = (n - F.length(head) - F.length(tail)).cast("string")
    return F.when(n <= most, text).otherwise(F.concat(head, F.lit("\n\n[... omitted "), left, F.lit(" chars ...]\n\n"), tail))


def clamp_cut(text: Column, most: int, margin: int, mark: str) -> Column:
    """The first most - margin characters of a longer text, and a mark."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - margin)), F.lit(mark)))


def normalise_space(text: Column) -> Column:
    out = F.regexp_replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit(" ")), "[ \\u00a0]{2,}", " ")
    return trim(F.regexp_replace(out, "\n{4,}", "\n\n\n"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\r?\n")


def unique_ci(values: Column, most: int) -> Column:
    """Trimmed, non-empty values, each once whatever its case, the first kept, at most `most`.

    Equal ones meet by sorting, so the work grows as n log n.
    """
    clean = F.filter(F.transform(values, trim), lambda x: x != "")
    ranked = F.array_sort(F.transform(clean, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    before = lambda s: F.concat(F.array(F.lit(None).cast("string")), F.transform(s, lambda p: p["k"]))
    paired = bind(ranked, lambda s: F.arrays_zip(s.alias("a"), before(s).alias("b")))
    first = F.filter(paired, lambda p: p["a"].isNotNull() & ~p["a"]["k"].eqNullSafe(p["b"]))
    return F.transform(F.slice(F.array_sort(F.transform(first, lambda p: F.struct(p["a"]["i"].alias("i"), p["a"]["x"].alias("x")))), 1, most), lambda p: p["x"])


def first_lines(text: Column, most: int = 400) -> Column:
    return F.slice(F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != ""), 1, most)


def terms(text: Column) -> Column:
    """Distinct lower-case words of three characters or more that are no stop words."""
    parts = F.split(F.lower(text), "[^a-z0-9_а-яё-]+")
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) >= 3) & ~x.isin(*STOP_WORDS)))


def stable_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def artifact_key(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), stable_hash(text, 20))


def redact(text: Column) -> Column:
    for pattern, by in SECRETS:
        text = F.regexp_replace(text, pattern, by)
    return text


def safe_preview(text: Column, most: int) -> Column:
    return clamp_cut(redact(trim(F.regexp_replace(text, r"\s+", " "))), most, 1, "…")


def safe_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def safe_id(text: Column, most: int = 80) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(trim(text)), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.substring(slug, 1, most)


def github_slug(heading: Column) -> Column:
    kept = F.regexp_replace(F.lower(trim(heading)), r"[^\p{L}\p{N}\s_-]", "")
    return F.regexp_replace(kept, r"\s", "-")


def extension(path: Column) -> Column:
    """With its dot, lower-cased; empty for none and for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def days_ago(at: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400)).cast("long")


def major(version: Column) -> Column:
    return F.regexp_extract(version, r"^[^\d]*(\d+)", 1).try_cast("int")


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
