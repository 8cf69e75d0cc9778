"""Depth of code modules: how much a module does for the surface that it shows, function bodies, and changes of either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.session import spread

# Weights, limits, and how a function or class begins.
LONG_BODY, DEEP_LEVEL, MANY_PARAMS = 25, 3, 4
SHALLOW_BELOW, DEEP_FROM = 3, 8
PER_SYMBOL, PER_PARAM, PER_LINE, PER_FUNCTION, PER_BRANCH, PER_LEVEL = 2.0, 0.5, 1, 2, 1, 3
BRANCH = r"\b(if|elif|else|for|while|except|case|catch|and|or)\b"
PYTHON_FUNCTION = r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("
PYTHON_CLASS = r"^\s*class\s+([A-Za-z_]\w*)"
SCRIPT_FUNCTION = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\("
SCRIPT_CLASS = r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"
SCRIPT_ARROW = r"^\s*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(?[^)]*\)?\s*=>"


def is_python(path: Column) -> Column:
    """All but script endings count as Python."""
    return ~path.rlike(r"\.(?:ts|tsx|js|jsx|mjs|cjs)$")


def _name(line: Column, *patterns: str) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns))


def _params(line: Column) -> Column:
    """Parameters between the first bracket and the one that closes it, on one line."""
    after = F.substr(line, F.instr(line, "(") + 1)
    # innermost pairs are emptied a few times, so that the next closing bracket is the first one's
    for _ in range(6):
        after = F.regexp_replace(after, r"\([^()]*\)", "")
    inside = F.when((F.instr(line, "(") > 0) & after.contains(")"), F.substring_index(after, ")", 1)).otherwise("")
    return F.size(F.filter(F.transform(F.split(inside, ","), T.trim), lambda p: ~p.isin("", "self", "cls", "*", "/")))


def _code(text: Column, python: Column) -> Column:
    """Structs (line, code) of the lines that are neither blank nor comments."""
    def kept(x: Column) -> Column:
        bare = F.trim(x["code"])
        return (T.trim(x["code"]) != "") & F.when(python, ~bare.startswith("#")).otherwise(~(bare.startswith("//") | bare.startswith("*") | bare.startswith("/*")))

    every = F.transform(T.lines_of(text), lambda x, i: F.struct((i + 1).alias("line"), F.replace(x, F.lit("\t"), F.lit("    ")).alias("code")))
    return F.filter(every, kept)


def _indent(code: Column) -> Column:
    return F.length(code) - F.length(F.ltrim(code))


def code_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, code, indent, function, class, params, public) of the lines that are neither blank nor comments."""
    python = is_python(F.col(path))
    rows = files.select(path, F.explode(_code(F.col(text), python)).alias("l")).select(path, "l.*")
    indent = _indent(F.col("code"))
    function = F.when(python, _name(F.col("code"), PYTHON_FUNCTION)).otherwise(_name(F.col("code"), SCRIPT_FUNCTION, SCRIPT_ARROW))
    class_ = F.when(python, _name(F.col("code"), PYTHON_CLASS)).otherwise(_name(F.col("code"), SCRIPT_CLASS))
    name = F.coalesce("function", "class")
    out = rows.withColumns({"indent": indent, "function": function, "class": class_})
    public = name.isNotNull() & (F.col("indent") == 0) & F.when(python, ~name.startswith("_")).otherwise(F.col("code").rlike(r"^\s*export\b"))
    return out.withColumns({"params": F.when(F.col("function").isNotNull(), _params(F.col("code"))).otherwise(0), "public": public})


def function_bodies(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, function, line, body_lines): lines below each function that are indented further, up to the first that is not.

    The end of a body is the next line with no more indent. Lines of one indent that follow a function's are found by
    a window for each indent level that occurs, so no line meets all others of its file.
    """
    lines = code_lines(files, path, text).select(path, "line", "indent", "function").withColumn("n", F.row_number().over(Window.partitionBy(path).orderBy("line")))
    heads = lines.filter("function is not null").select(path, "function", "line", "indent", "n")
    # the first later line of indent <= i, for every indent i that a function of the file has
    levels = heads.select(path, F.col("indent").alias("level")).distinct()
    ends = lines.select(path, "n", "indent").join(levels, path).filter("indent <= level")
    after = F.lead("n").over(Window.partitionBy(path, "level").orderBy("n"))
    ends = ends.select(path, F.col("level").alias("indent"), "n", after.alias("end"))
    total = lines.groupBy(path).agg(F.max("n").alias("last"))
    both = heads.join(ends, [path, "indent", "n"]).join(total, path)
    return both.select(path, "function", "line", (F.coalesce("end", F.col("last") + 1) - F.col("n") - 1).cast("int").alias("body_lines"))


def module_depth(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, interface, complexity, ratio, band, public_symbols, loc, factors) of each file.

    The rows of lines are summed up by their file as small numbers; only surfaces with many parameters and the lines of
    files that are long enough for a long function are gathered.
    """
    files = spread(files.select(path, text))
    many = F.when(F.col("public") & (F.col("params") > MANY_PARAMS), F.concat_ws(":", F.lit("many_params"), F.coalesce("function", "class"), F.col("params").cast("string")))
    rows = code_lines(files, path, text).select(path, "line", "indent", F.regexp_count("code", F.lit(BRANCH)).alias("branches"), F.col("function").isNotNull().alias("is_function"), "public", "params", many.alias("what"))
    of = rows.groupBy(path).agg(
        F.count_if(F.col("indent") > 0).alias("loc"), F.sum("branches").alias("branches"), F.min(F.when(F.col("indent") > 0, F.col("indent"))).alias("unit"), F.max("indent").alias("deepest"),
        F.count_if("is_function").alias("functions"), F.count_if("public").alias("public_symbols"), F.sum(F.when(F.col("public"), F.col("params")).otherwise(0)).alias("public_params"),
    )
    of = of.withColumn("nesting", F.round(F.col("deepest") / F.coalesce("unit", F.lit(4))).cast("int")).drop("unit", "deepest")  # the deepest line has the highest level
    wide = rows.filter("what is not null").groupBy(path).agg(F.array_sort(F.collect_list(F.struct("line", "what"))).alias("many"))
    of = of.join(wide, path, "left")
    god = F.struct("line", F.concat_ws(":", F.lit("god_function"), "function", F.col("body_lines").cast("string")).alias("what"))
    tall = files.filter(F.size(T.lines_of(F.col(text))) > LONG_BODY)
    long = function_bodies(tall, path, text).filter(F.col("body_lines") > LONG_BODY).groupBy(path).agg(F.array_sort(F.collect_list(god)).alias("god"))
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<line:int,what:string>>")), lambda x: x["what"])
    deep = F.when(F.col("nesting") > DEEP_LEVEL, F.array(F.concat(F.lit("deep_nesting:"), F.col("nesting").cast("string")))).otherwise(F.array().cast("array<string>"))
    complexity = F.col("loc") * PER_LINE + F.col("functions") * PER_FUNCTION + F.col("branches") * PER_BRANCH + F.greatest(F.lit(0), F.col("nesting") - 1) * PER_LEVEL
    interface = F.col("public_symbols") * PER_SYMBOL + F.col("public_params") * PER_PARAM
    out = of.join(long, path, "left").withColumns({"complexity": complexity.cast("long"), "interface": interface.cast("double"), "factors": F.concat(names(F.col("many")), names(F.col("god")), deep)})
    ratio = F.round(F.col("complexity") / F.greatest(F.col("interface"), F.lit(1.0)), 2)
    band = F.when(F.col("ratio") < SHALLOW_BELOW, "shallow").when(F.col("ratio") >= DEEP_FROM, "deep").otherwise("balanced")
    return out.withColumn("ratio", ratio).select(path, "interface", "complexity", "ratio", band.alias("band"), "public_symbols", "loc", "factors")


def depth_compare(before: DataFrame, after: DataFrame, path: str = "path") -> DataFrame:
    """(path, delta, direction, band_before, band_after) of modules in both."""
    old = before.select(path, F.col("ratio").alias("was"), F.col("band").alias("band_before"))
    both = after.select(path, "ratio", F.col("band").alias("band_after")).join(old, path).withColumn("delta", F.round(F.col("ratio") - F.col("was"), 2))
    return both.select(path, "delta", depth_direction(F.col("delta")).alias("direction"), "band_before", "band_after")


def depth_direction(delta: Column) -> Column:
    return F.when(delta > 0.5, "deeper").when(delta < -0.5, "shallower").otherwise("flat")
