"""Source trees and Markdown trees as (path, text): symbols, imports, exports, complexity, sections, links, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions.predicates import is_external_link, matches
from strataloom.session import spread

# What declares a symbol, an import, an export, a branch.
NAME = "[A-Za-z_$][A-Za-z0-9_$]*"
SYMBOLS = (
    ("function", rf"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+({NAME})\s*\("), ("class", rf"^(?:export\s+)?(?:default\s+)?class\s+({NAME})\b"), ("type", rf"^(?:export\s+)?(?:interface|type|enum)\s+({NAME})\b"),
    ("function", rf"^(?:export\s+)?(?:const|let|var)\s+({NAME})\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|{NAME}\s*=>)"), ("function", r"^(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
    ("function", r"^(?:function\s+)?([A-Za-z_][A-Za-z0-9_-]*)\s*\(\)\s*\{"),
)
PYTHON_IMPORTS = (("import", r"^from\s+([A-Za-z0-9_.]+)\s+import\b"), ("import", r"^import\s+([A-Za-z0-9_.]+)"))
#: Keys of data files and headings of documents, by file ending; YAML and TOML keys only where a line begins with them.
OUTLINES = {
    r"\.ya?ml$": r"^([A-Za-z0-9_.-]+):\s*", r"\.json$": r"^\s*\"([A-Za-z0-9_.-]{2,80})\"\s*:", r"\.toml$": r"^(?:\[+([A-Za-z0-9_.-]+)\]+|([A-Za-z0-9_.-]+)\s*=)",
}
IMPORTS = (
    ("import", r"""\bimport\s+(?:type\s+)?(?:[^"']+\s+from\s+)?["']([^"']+)["']"""), ("export", r"""\bexport\s+[^"']+\s+from\s+["']([^"']+)["']"""), ("require", r"""\brequire\(\s*["']([^"']+)["']\s*\)"""), ("dynamic_import", r"""\bimport\(\s*["'`]([^"'`]+)["'`]\s*\)"""),
)
EXPORTED = r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)"
FUNCTIONS = r"\b(?:function|class|=>)\b"
BRANCHES = r"\b(?:if|for|while|case|catch|switch)\b|\?\s|&&|\|\|"
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
LINK = r"!?\[[^\]]*\]\(([^)]+)\)"
MARKER = r"\b(?:TODO|FIXME)\b|-\s+\[\s\]|^\s*(?:[-*]\s*)?Action\s*:"
CONFLICT = r"\b(?:notion|confluence|google docs|gdrive)\b.{0,80}\b(?:ssot|source of truth|canonical)\b|\b(?:ssot|source of truth|canonical)\b.{0,80}\b(?:notion|confluence|google docs|gdrive)\b"
PER_FILE = 160
MIRROR = "mirror|not ssot|repo.*ssot|markdown.*ssot"


def numbered(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(T.lines_of(F.coalesce("text", F.lit("")))).alias("pos", "x")).select("path", (F.col("pos") + 1).alias("line"), T.trim(F.col("x")).alias("x"))


def _found(rows: DataFrame, patterns: tuple, name: str, most: int | None, per_file: int | None) -> DataFrame:
    fits = lambda e: (e[name] != "") & (F.lit(True) if most is None else F.length(e[name]) <= most)
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.regexp_extract("x", p, 1).alias(name), F.lit(i).alias("i")) for i, (kind, p) in enumerate(patterns)))
    out = rows.select("path", "line", F.explode(F.filter(each, fits)).alias("e")).select("path", "line", "e.*")
    if per_file is None:
        return out.drop("i")
    w = Window.partitionBy("path").orderBy("line", "i")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_file).drop("rank", "i")


def symbols(files: DataFrame, per_file: int | None = PER_FILE, longest: int | None = 140) -> DataFrame:
    """(path, line, kind, name), the first `per_file` of each file with names of at most `longest` characters; None takes all."""
    return _found(numbered(files), SYMBOLS, "name", longest, per_file)


def imports(files: DataFrame, per_file: int | None = PER_FILE, longest: int | None = 220) -> DataFrame:
    """(path, line, kind, target), likewise; Python files have their own statements."""
    python = F.col("path").rlike(r"\.pyi?$")
    rows = numbered(files)
    return _found(rows.filter(~python), IMPORTS, "target", longest, per_file).unionByName(_found(rows.filter(python), PYTHON_IMPORTS, "target", longest, per_file))


def outline(files: DataFrame) -> DataFrame:
    """(path, line, kind, name) of headings of Markdown files and keys of YAML, JSON and TOML files."""
    rows = files.select("path", F.posexplode(T.lines_of(F.coalesce("text", F.lit("")))).alias("pos", "x")).select("path", (F.col("pos") + 1).alias("line"), "x")
    level = F.length(F.regexp_extract("x", HEADING, 1))
    name, kind = F.when(F.col("path").rlike(r"\.mdx?$"), F.regexp_extract("x", HEADING, 2)), F.concat(F.lit("heading"), level.cast("string"))
    for ending, pattern in OUTLINES.items():
        groups = [F.regexp_extract("x", pattern, i) for i in range(1, pattern.count("([") + 1)]
        name = name.when(F.col("path").rlike(ending), F.coalesce(*(F.nullif(g, F.lit("")) for g in groups), F.lit("")))
    return rows.select("path", "line", F.when(F.col("path").rlike(r"\.mdx?$"), kind).otherwise("key").alias("kind"), name.alias("name")).filter("name <> ''")


def package_name(target: Column) -> Column:
    """Of an import; empty for a local or built-in one."""
    parts = F.split(target, "/")
    local = target.startswith(".") | target.startswith("/") | target.startswith("node:")
    return F.when(local, "").when(target.startswith("@"), F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(parts[0])


def exported_names(files: DataFrame) -> DataFrame:
    direct = F.regexp_extract_all("text", F.lit(EXPORTED), 1)
    return files.select("path", F.explode(F.array_distinct(direct)).alias("name")).filter(F.length("name") >= 3)


def unused_exports(files: DataFrame) -> DataFrame:
    """Exported names that occur once at most as a whole word in all files: words are counted once, not searched per name."""
    files = spread(files.select("path", "text"))
    words = files.select(F.explode(F.split("text", r"[^A-Za-z0-9_$]+")).alias("name")).groupBy("name").agg(F.count("*").alias("uses"))
    return exported_names(files).join(words.filter("uses > 1"), "name", "left_anti").select("path", "name")


def complexity(files: DataFrame, top: int = 50) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    lines = F.size(F.filter(T.lines_of(t), lambda x: T.trim(x) != ""))
    n = lambda p: F.regexp_count(t, F.lit(p))
    specs = sum(n(p) for _, p in IMPORTS)
    counts = F.struct(lines.alias("lines"), n(FUNCTIONS).alias("functions"), n(BRANCHES).alias("branches"), specs.alias("imports"))
    # exploded, since the filter would be pushed in front of the dealing and count in one task and once more
    out = spread(files.select("path", "text")).select("path", F.explode(F.array(counts)).alias("c")).select("path", "c.*")
    score = 2 * F.col("branches") + 3 * F.col("functions") + F.col("imports") + F.ceil(F.col("lines") / 40.0)
    return out.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), F.desc("lines"), "path").limit(top)


# --- Markdown ---------------------------------------------------------------------------------


def headings(files: DataFrame) -> DataFrame:
    """(path, line, level, title, anchor); the n-th equal anchor of a file gets a number."""
    rows = numbered(files).withColumn("level", F.length(F.regexp_extract("x", HEADING, 1))).filter("level > 0")
    title = F.substring(T.trim(F.regexp_extract("x", HEADING, 2)), 1, 160)
    rows = rows.select("path", "line", "level", title.alias("title")).withColumn("slug", T.github_slug(F.col("title")))
    n = F.row_number().over(Window.partitionBy("path", "slug").orderBy("line")) - 1
    return rows.withColumn("anchor", F.when(n == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), n.cast("string")))).drop("slug")


def links(files: DataFrame) -> DataFrame:
    """Local links (src, line, target, anchor), relative to the file's folder."""
    each = numbered(files).select(F.col("path").alias("src"), "line", F.explode(F.regexp_extract_all("x", F.lit(LINK), 1)).alias("raw"))
    each = each.withColumn("raw", F.substring_index(F.trim("raw"), " ", 1)).filter(~is_external_link(F.col("raw")) & (F.col("raw") != ""))
    return each.select("src", "line", F.regexp_replace(F.substring_index("raw", "#", 1), "^[.]/", "").alias("target"), F.when(F.instr("raw", "#") > 0, F.substring_index("raw", "#", -1)).otherwise("").alias("anchor"))


def sections(files: DataFrame) -> DataFrame:
    """(path, section, start, body): the lines behind each heading, by a running count of headings."""
    rows = numbered(files).withColumn("is_heading", (F.regexp_extract("x", HEADING, 1) != "").cast("int"))
    rows = rows.withColumn("section", F.sum("is_heading").over(Window.partitionBy("path").orderBy("line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_heading") == 0, F.struct("line", "x")))), lambda p: p["x"]), "\n")
    return rows.filter("section > 0").groupBy("path", "section").agg(F.min("line").alias("start"), body.alias("body"), F.count_if((F.col("is_heading") == 0) & (F.col("x") != "")).alias("lines"))


def normal_section(body: Column) -> Column:
    for p in (r"(?s)```.*?```", "`[^`]+`", r"\[[^\]]+\]\([^)]+\)", r"https?://\S+", r"[^\p{L}\p{N}\s]", r"\s+"):
        body = F.regexp_replace(body, p, " ")
    return F.lower(F.trim(body))


def duplicate_sections(files: DataFrame, least_lines: int = 4, least_chars: int = 120) -> DataFrame:
    rows = sections(files).withColumn("normal", normal_section(F.col("body"))).filter((F.col("lines") >= least_lines) & (F.length("normal") >= least_chars))
    per = rows.groupBy(T.stable_hash(F.col("normal")).alias("hash"), "path").agg(F.count("*").alias("n"), F.min("start").alias("start"))
    return per.groupBy("hash").agg(F.count("*").alias("files"), F.sum("n").alias("occurrences"), F.min(F.struct("path", "start")).alias("first")).filter("files > 1").select("hash", "files", "occurrences", F.col("first.path").alias("first_path"), F.col("first.start").alias("first_line"))


def markers(files: DataFrame) -> DataFrame:
    """Open points: checkbox, FIXME, TODO or action."""
    rows = numbered(files).filter(matches(F.col("x"), MARKER))
    kind = F.when(F.col("x").rlike(r"-\s+\[\s\]"), "checkbox").when(matches(F.col("x"), r"\bFIXME\b"), "fixme").when(matches(F.col("x"), r"\bTODO\b"), "todo").otherwise("action")
    return rows.select("path", "line", kind.alias("kind"))


def truth_conflicts(files: DataFrame) -> DataFrame:
    """Lines that call another system the source of truth, and do not speak of a mirror."""
    return numbered(files).filter(matches(F.col("x"), CONFLICT) & ~matches(F.col("x"), MIRROR)).select("path", "line", T.stable_hash(F.col("x")).alias("hash"))


def inventory(files: DataFrame) -> DataFrame:
    from strataloom.functions.predicates import has_frontmatter

    l = T.lines_of(F.coalesce("text", F.lit("")))
    return files.select("path", F.size(l).alias("lines"), F.size(F.filter(l, lambda x: x.rlike(HEADING))).alias("headings"), has_frontmatter(F.coalesce("text", F.lit(""))).alias("frontmatter"), (F.size(l) >= 800).alias("large"))


def rule_hits(files: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """How many lines and files each rule (name, pattern) hits; a pass over the lines for all rules, no join."""
    each = F.array(*(F.when(F.col("x").rlike(p), F.lit(name)) for name, p in rules))
    rows = numbered(files).select("path", F.explode(F.array_compact(each)).alias("rule"))
    hit = rows.groupBy("rule").agg(F.count("*").alias("hits"), F.count_distinct("path").alias("files"))
    names = files.sparkSession.createDataFrame([(n,) for n, _ in rules], "rule string")
    return names.join(hit, "rule", "left").fillna(0)
