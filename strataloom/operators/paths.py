"""Which paths a search may look at: ignore patterns as globs, globs as regular expressions, references in documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as T

# Directories and files that are left out at any depth, and those of tests.
LEFT_OUT_DIRS = (".claude/worktrees", "node_modules", "dist", "build", "coverage", ".next", ".turbo", "vendor")
LEFT_OUT_FILES = ("*.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "CREDENTIALS.md", ".env", ".env.*", "*secret*", "*token*", "*credential*", "auth.json", "*.pem", "*.key", "*.sqlite", "*.sqlite-*")
TEST_DIRS, TEST_FILES = ("__tests__", "tests", "test", "specs"), ("*.test.*", "*.spec.*")
DEFAULT_EXCLUDES = (".git/**", *(f"{p}{d}/**" for d in LEFT_OUT_DIRS for p in ("", "**/")), *(f"**/{f}" for f in LEFT_OUT_FILES))
TEST_EXCLUDES = (*(f"**/{d}/**" for d in TEST_DIRS), *(f"**/{f}" for f in TEST_FILES))
# Paths in documents: in back quotes, or bare below a usual top directory.
CODE_PATH = r"`([^`\n]+\.(?:ts|tsx|js|jsx|mjs|cjs|py|sh|json|ya?ml|mdx?)(?::\d+)?)`"
BARE_PATH = r"(?:^|[\s(\[\"'])((?:services|scripts|notes|claude|projects|src|app|lib|content|data|analyzers|templates)/[A-Za-z0-9_./-]+\.(?:ts|tsx|js|jsx|mjs|cjs|py|sh|json|ya?ml|mdx?)(?::\d+)?)"
DOC_PATHS = (r"`([^`]+\.(?:md|mdx))`", r"(?m)(?:^|\s)([A-Za-z0-9_./-]+\.(?:md|mdx))(?=\s|$)")


def ignore_globs(pattern: str) -> list[str]:
    """The globs that a line of an ignore file stands for; none for comments, blanks and lines that take back an ignore."""
    name = re.sub(r"^(?:\./)?/*", "", pattern.strip())
    if not name or pattern.strip()[0] in "#!":
        return []
    bare = name.rstrip("/")
    if name != bare:
        return [f"{bare}/**", f"**/{bare}/**"]
    return [bare, f"{bare}/**"] if "/" in bare else [bare, f"**/{bare}", f"{bare}/**", f"**/{bare}/**"]


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: ** crosses directories, * and ? do not."""
    parts = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(parts.get(x, re.escape(x) if not x.startswith("[") else x) for x in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]/]+\]|.", glob))


def path_policy(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), ignore: tuple[str, ...] = (), include_tests: bool = True) -> Column:
    """Whether a path may be looked at: it fits an included glob, if there are any, and no excluded one. One regular expression each."""
    out = [g for g in (*DEFAULT_EXCLUDES, *(() if include_tests else TEST_EXCLUDES), *(g for line in ignore for g in ignore_globs(line)), *(x.strip().lstrip("!") for x in exclude)) if g]
    joined = lambda globs: "^(?:" + "|".join(dict.fromkeys(map(glob_regex, globs))) + ")$"
    fits = path.rlike(joined([g for g in include if g.strip()])) if any(g.strip() for g in include) else F.lit(True)
    return fits & ~path.rlike(joined(out))


def is_placeholder_link(target: Column) -> Column:
    """A link target that is no path: empty, a stand-in, a pattern, or a bare domain."""
    t = T.trim(target)
    stand_in = t.isin("", "-", ".") | t.rlike("(?i)^url$")
    pattern = t.rlike(r"\.\.\.|[\[\]|]|\(\?:|\.\*")
    domain = t.rlike(r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/|$)") & ~t.rlike(r"^\.\.?/")
    return stand_in | pattern | domain


def is_local_path(ref: Column, aliases: tuple[str, ...] = ()) -> Column:
    """A reference that can be looked up in the tree: relative, with a slash, no pattern, no url."""
    scoped = ref.startswith("@")
    for a in aliases:
        scoped = scoped & ~ref.startswith(a)
    return ref.contains("/") & ~ref.startswith("/") & ~ref.contains("://") & ~scoped & ~ref.startswith("~") & ~ref.rlike(r"<[^>]+>|\.\.\.|…|[*?\[\]{}]|\s")


def path_references(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, ref, line): each path that a document names, in back quotes or bare, with its first line."""
    lines = docs.select(path, F.posexplode(T.lines_of(F.coalesce(text, F.lit("")))).alias("pos", "x"))
    refs = F.concat(F.regexp_extract_all("x", F.lit(CODE_PATH), 1), F.regexp_extract_all("x", F.lit(BARE_PATH), 1))
    found = lines.select(path, (F.col("pos") + 1).alias("line"), F.explode(F.transform(refs, T.trim)).alias("ref"))
    return found.filter("ref <> ''").groupBy(path, "ref").agg(F.min("line").alias("line"))


def registry_paths(registries: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, path) of document registries: a JSON list of paths or of objects with source_path (also under docs), else paths in Markdown."""
    text, v = F.col(raw), F.try_parse_json(raw)
    items = F.coalesce(F.try_variant_get(v, "$.docs", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    named = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.source_path", "string")))
    found = F.when(v.isNotNull(), F.array_compact(named)).otherwise(F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in DOC_PATHS)))
    return registries.select(key, F.explode(F.array_distinct(found)).alias("path"))


def test_counterparts(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, test): tests beside a source, or in its __tests__ folder, that have its name; an equi-join, whatever the case."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    folder = F.regexp_replace(F.regexp_replace(low, "/?[^/]*$", ""), "(?:^|/)__tests__$", "")
    is_test = name.rlike(r"\.(?:test|spec)(?:\.|$)") | low.rlike("(?:^|/)__tests__/[^/]*$")
    stem = F.regexp_replace(F.regexp_replace(name, r"\.(?:test|spec)(?:\..*)?$", ""), r"\.[^.]*$", "")
    rows = files.select(path, folder.alias("folder"), stem.alias("stem"), is_test.alias("is_test"))
    tests = rows.filter("is_test").select(F.col(path).alias("test"), "folder", "stem")
    return rows.filter(~F.col("is_test")).join(tests, ["folder", "stem"]).select(path, "test")


def inferred_globs(paths: Column, most: int = 8) -> Column:
    """Globs of the top directories of some paths; a file at the top stands for itself."""
    top = F.transform(paths, lambda p: F.when(p.contains("/"), F.concat(F.substring_index(p, "/", 1), F.lit("/**"))).otherwise(p))
    return F.slice(F.array_distinct(top), 1, most)


def top_extensions(files: DataFrame, path: str = "path", most: int = 8) -> DataFrame:
    """(extension, files) of the most frequent extensions, by count and name."""
    out = files.groupBy(F.coalesce(F.nullif(T.extension(F.col(path)), F.lit("")), F.lit("[none]")).alias("extension")).agg(F.count("*").alias("files"))
    return out.orderBy(F.desc("files"), "extension").limit(most)
