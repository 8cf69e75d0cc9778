"""Findings of compilers, linters, scanners and test runs, from their raw outputs, and the status of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as T

# Line formats.
TSC_LINE = r"^(.+?)\((\d+),(\d+)\):\s+(error|warning)\s+(TS\d+):\s+(.+)$"
ESLINT_LINE = r"^(.+?):(\d+):(\d+)\s+(error|warning)\s+(.+?)(?:\s+([@\w/-]+))?$"
FAILURE_LINE = "(?i)fail|failed|error|exception"
MOST_FAILURES = 30


def finding(source: str, severity: Column, message: Column, rule: Column | None = None, file: Column | None = None, line: Column | None = None, column: Column | None = None) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        *(F.coalesce(x, none(kind)).cast(kind).alias(n) for n, x, kind in (("file", none("string") if file is None else file, "string"), ("line", none("int") if line is None else line, "int"), ("column", none("int") if column is None else column, "int"))),
        message.alias("message"), (none("string") if rule is None else rule).alias("rule_id"), severity.alias("severity"), F.lit(source).alias("source"),
    )


def relative(path: Column, root: str = "") -> Column:
    """With forward slashes, and from the root on."""
    out = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(out.startswith(root.rstrip("/") + "/"), F.substr(out, F.lit(len(root.rstrip("/")) + 2))).otherwise(out) if root else out


def _by_lines(output: Column, pattern: str, make) -> Column:
    hits = F.filter(F.transform(F.split(output, "\n"), T.trim), lambda x: x.rlike(pattern))
    part = lambda x: lambda i: F.regexp_extract(x, pattern, i)
    return F.transform(hits, lambda x: make(part(x)))


def tsc(output: Column, root: str = "") -> Column:
    return _by_lines(output, TSC_LINE, lambda g: finding("tsc", g(4), T.trim(g(6)), g(5), relative(g(1), root), g(2), g(3)))


def eslint(output: Column, root: str = "") -> Column:
    """From the JSON report, else from lines."""
    shape = "array<struct<filePath:string,messages:array<struct<line:int,column:int,message:string,ruleId:string,severity:int>>>>"
    of = lambda f, m: finding("eslint", F.when(m["severity"] == 2, "error").otherwise("warning"), F.coalesce(F.nullif(m["message"], F.lit("")), F.lit("ESLint finding")), m["ruleId"], relative(f["filePath"], root), m["line"], m["column"])
    report = F.flatten(F.transform(F.from_json(output, shape), lambda f: F.transform(F.coalesce(f["messages"], F.array()), lambda m: of(f, m))))
    lines = _by_lines(output, ESLINT_LINE, lambda g: finding("eslint", g(4), T.trim(g(5)), F.nullif(g(6), F.lit("")), relative(g(1), root), g(2), g(3)))
    return F.when(is_json_array(output), report).otherwise(lines)


def is_json_array(output: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(output)).startswith("ARRAY"), F.lit(False))


def semgrep(output: Column, root: str = "") -> Column:
    shape = "struct<results:array<struct<path:string,start:struct<line:int,col:int>,extra:struct<message:string,severity:string>,check_id:string>>>"
    severity = lambda r: F.when(F.lower(r["extra"]["severity"]) == "error", "error").otherwise("warning")
    one = lambda r: finding("semgrep", severity(r), F.coalesce(F.nullif(r["extra"]["message"], F.lit("")), F.lit("Semgrep finding")), r["check_id"], relative(r["path"], root), r["start"]["line"], r["start"]["col"])
    return F.transform(F.from_json(output, shape)["results"], one)


def gitleaks(output: Column, root: str = "") -> Column:
    shape = "array<struct<File:string,StartLine:int,Description:string,RuleID:string>>"
    one = lambda r: finding("gitleaks", F.lit("error"), F.coalesce(F.nullif(r["Description"], F.lit("")), F.lit("Potential secret detected")), r["RuleID"], relative(r["File"], root), r["StartLine"])
    return F.when(is_json_array(output), F.transform(F.from_json(output, shape), one))


def test_failures(output: Column, most: int = MOST_FAILURES) -> Column:
    """The first lines that tell of a failure; only these have a limit, as in the report they come from."""
    hits = F.slice(F.filter(F.transform(F.split(output, "\n"), T.trim), lambda x: x.rlike(FAILURE_LINE)), 1, most)
    return F.transform(hits, lambda x: finding("tests", F.when(F.lower(x).contains("warn"), "warning").otherwise("error"), T.clamp_cut(x, 500, 24, "\n...[truncated]")))


PARSERS = {"tsc": tsc, "eslint": eslint, "semgrep": semgrep, "gitleaks": gitleaks}


def findings(runs: DataFrame, key: str, tool: str, output: str = "output", root: str = "") -> DataFrame:
    """(key, place, file, line, column, message, rule_id, severity, source) of each finding in a tool's outputs."""
    parsed = test_failures(F.col(output)) if tool == "tests" else PARSERS[tool](F.col(output), root)
    return runs.select(key, F.posexplode(parsed).alias("place", "f")).select(key, (F.col("place") + 1).alias("place"), "f.*")


def status_from_exit(code: Column, errors: Column, timed_out: Column | None = None) -> Column:
    """error for a run that did not end or whose command is missing; passed for exit 0 without errors; else failed."""
    late = F.lit(False) if timed_out is None else F.coalesce(timed_out, F.lit(False))
    return F.when(late | code.isNull() | (code == 127), "error").when((code == 0) & (F.coalesce(errors, F.lit(0)) == 0), "passed").otherwise("failed")


def finding_counts(found: DataFrame, *keys: str) -> DataFrame:
    of = lambda s: F.count_if(F.col("severity") == s)
    return found.groupBy(*keys).agg(F.count("*").alias("total"), of("error").alias("errors"), of("warning").alias("warnings"), of("notice").alias("notices"))


def limited(found: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first findings in order, each with the count of all and whether some are left out."""
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(*order).limit(most).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > most)


def changed_assertions(old: DataFrame, new: DataFrame, key: str, pattern: str, skips: str) -> DataFrame:
    """(key, kind, text): trimmed assertion lines of old that new lacks, and skip marks of new that old lacks."""
    side = lambda rows: rows.select(key, F.explode(F.split("text", "\n")).alias("text")).select(key, T.trim(F.col("text")).alias("text")).distinct()
    was, now = side(old), side(new)
    gone = was.filter(F.col("text").rlike(pattern)).join(now, [key, "text"], "left_anti").select(key, F.lit("removed assertion").alias("kind"), "text")
    added = now.filter(F.col("text").rlike(skips)).join(was, [key, "text"], "left_anti").select(key, F.lit("new skip").alias("kind"), "text")
    return gone.unionByName(added)


# --- property tests -----------------------------------------------------------------------------

# Marks in the outputs of property test runners, and generators by what an input is called.
IMPORT_ERROR, SYNTAX_ERROR = r"\b(?:ImportError|ModuleNotFoundError|No module named)\b", r"\bSyntaxError\b"
NO_MODULE = r"\b(?:Cannot find module|ERR_MODULE_NOT_FOUND|MODULE_NOT_FOUND)\b"
MOST_ASSIGNMENTS = 50
STRATEGIES = [
    (r"non-empty\s+string", "st.text(min_size=1)", "fc.string({ minLength: 1 })"),
    (r"positive\s+integer", "st.integers(min_value=1)", "fc.integer({ min: 1 })"),
    (r"negative\s+integer", "st.integers(max_value=-1)", "fc.integer({ max: -1 })"),
    (r"non-negative\s+integer", "st.integers(min_value=0)", "fc.integer({ min: 0 })"),
    (r"list\s+of\s+integers?", "st.lists(st.integers())", "fc.array(fc.integer())"),
    (r"list\s+of\s+strings?|list\s+of\s+text", "st.lists(st.text())", "fc.array(fc.string())"),
    (r"\binteger\b|\bint\b", "st.integers()", "fc.integer()"),
    (r"\bstring\b|\btext\b", "st.text()", "fc.string()"),
    (r"\bfloat\b|\bdouble\b|\bnumber\b", "st.floats(allow_nan=False, allow_infinity=False)", "fc.float({ noNaN: true })"),
    (r"\bboolean\b|\bbool\b", "st.booleans()", "fc.boolean()"),
    (r"\blist\b|\barray\b", "st.lists(st.integers())", "fc.array(fc.integer())"),
    (r"\bdict\b|\bdictionary\b|\bmap\b|\bobject\b", "st.dictionaries(st.text(), st.integers())", "fc.dictionary(fc.string(), fc.integer())"),
]
ELSE_STRATEGY = ("st.integers()", "fc.integer()")


def strategy(description: Column, language: str = "python") -> Column:
    """The generator for an input, by the first rule that fits its description."""
    side = 1 if language == "python" else 2
    out = F.when(F.lit(False), "")
    for rule in STRATEGIES:
        out = out.when(description.rlike("(?i)" + rule[0]), rule[side])
    return out.otherwise(ELSE_STRATEGY[side - 1])


def assignments(block: Column) -> Column:
    """name=value pairs of a counterexample, at most 50 (they are for reading)."""
    parts = F.transform(F.split(block, r"[,\n)]"), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, "=") + 1)).alias("v"), (F.instr(x, "=") > 0).alias("has")))
    good = F.filter(parts, lambda p: p["has"] & p["k"].rlike(r"^[a-zA-Z_]\w{0,99}$") & F.length(p["v"]).between(1, 400))
    return F.nullif(F.array_join(F.transform(F.slice(good, 1, MOST_ASSIGNMENTS), lambda p: F.concat(p["k"], F.lit("="), p["v"])), ", "), F.lit(""))


def property_outcome(stdout: Column, stderr: Column, code: Column, language: str = "python") -> Column:
    """(outcome, counterexample, shrunk, tried) of a property test run: error, falsified or passed."""
    both = F.concat(F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit("")))
    number = lambda p: F.regexp_extract(both, p, 1).try_cast("int")
    row = lambda outcome, example=None, shrunk=None, tried=None: F.struct(F.lit(outcome).alias("outcome"), (F.lit(None).cast("string") if example is None else example).alias("counterexample"), (F.lit(None).cast("string") if shrunk is None else shrunk).alias("shrunk"), (F.lit(None).cast("int") if tried is None else tried).alias("tried"))
    if language == "python":
        block = F.trim(F.substring_index(F.regexp_extract(stderr, r"(?is)Falsifying example:(.*)$", 1), "\n\n", 1))
        broken = F.coalesce(stderr.rlike(IMPORT_ERROR) | stderr.rlike(SYNTAX_ERROR), F.lit(False))
        found, example, shrunk, tried = F.coalesce(stderr.rlike("(?i)Falsifying example:"), F.lit(False)), block, assignments(block), F.lit(None).cast("int")
    else:
        line = F.nullif(F.trim(F.substring(F.regexp_extract(both, "(?i)counterexample:([^\n]*)", 1), 1, 500)), F.lit(""))
        broken, found, example, shrunk, tried = both.rlike(NO_MODULE), line.isNotNull(), line, line, number(r"(?i)after\s{1,10}(\d{1,9})\s{1,10}tests?")
    passed = row("passed", tried=number(r"(?i)(\d{1,9})\s{1,10}examples?\s{1,10}(?:passed|tried)") if language == "python" else None)
    return F.when(broken, row("error")).when(found, row("falsified", example, shrunk, tried)).when(code == 0, passed).otherwise(row("error"))
