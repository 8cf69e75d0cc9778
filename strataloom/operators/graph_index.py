"""An index of a source tree that is kept up to date: files, symbols, imports with what they lead to, uses of symbols.

Tables in a folder, all but the last two a folder a bucket of paths, so that an update rewrites only buckets with edits:
`files` (path, size_bytes, mtime_ms, content_hash, symbols, imports), `symbols` (path, line, kind, name), `imports`
(path, line, kind, target), `tokens` (path, line, token): the different names of each line. `resolved` (imports with
resolved_path) and `references` (symbol, path, line) join these and are made anew, without reading a text again.

An update parses the files that are new or whose size or time has changed, takes the rest of their buckets as it is,
and drops what is gone. New buckets are written before old ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.text import lines_of
from strataloom.operators import code as C
from strataloom.operators.dependencies import folder_of
from strataloom.operators.graph import marked
from strataloom.session import saved, spread

BUCKETS = 32
# Fixed values.
TOKEN = "[A-Za-z_$][A-Za-z0-9_$-]{2,79}"
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".json", ".md", ".yaml", ".yml")
REFERRED = ("class", "function", "route", "tool", "type", "key")
PER_SYMBOL = 80
TABLES = ("files", "symbols", "imports", "tokens")
SCHEMAS = {
    "files": "path string, size_bytes long, mtime_ms long, content_hash string, symbols long, imports long, bucket int", "symbols": "path string, line int, kind string, name string, bucket int",
    "imports": "path string, line int, kind string, target string, bucket int", "tokens": "path string, line int, token string, bucket int",
    "resolved": "path string, target string, line int, kind string, resolved_path string", "references": "symbol string, path string, line int",
}


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def parsed(files: DataFrame, buckets: int, per_file: int | None = C.PER_FILE) -> dict[str, DataFrame]:
    """The tables of files (path, text, size_bytes, mtime_ms)."""
    files = saved(spread(files.select("path", "text", "size_bytes", "mtime_ms")))  # read for each table, and what makes it only once
    data = F.col("path").rlike(r"(?i)\.(mdx?|ya?ml|json)$")
    outline = C.outline(files.filter(data)).select("path", "line", "kind", "name")
    symbols = C.symbols(files.filter(~data), per_file).select("path", "line", "kind", "name").unionByName(outline)
    imports = C.imports(files.filter(~data), per_file).select("path", "line", "kind", "target")
    lines = files.select("path", F.posexplode(lines_of(F.coalesce("text", F.lit("")))).alias("pos", "x"))
    tokens = lines.select("path", (F.col("pos") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("x", F.lit(TOKEN), F.lit(0)))).alias("token"))
    symbols, imports = saved(symbols), saved(imports)
    count = lambda rows, name: rows.groupBy("path").agg(F.count("*").alias(name))
    facts = files.select("path", F.col("size_bytes").cast("long").alias("size_bytes"), F.col("mtime_ms").cast("long").alias("mtime_ms"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    facts = facts.join(count(symbols, "symbols"), "path", "left").join(count(imports, "imports"), "path", "left").fillna(0, ["symbols", "imports"])
    return {k: v.withColumn("bucket", bucket_of(F.col("path"), buckets)) for k, v in zip(TABLES, (facts, symbols, imports, tokens))}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def written(rows: DataFrame, path: str, mode: str) -> None:
    """Buckets are folders; in an update only those in rows are replaced."""
    rows.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def build(files: DataFrame, folder: str, buckets: int = BUCKETS, per_file: int | None = C.PER_FILE, per_symbol: int | None = PER_SYMBOL) -> None:
    """Index files (path, text, size_bytes, mtime_ms), each path once. per_file and per_symbol: None takes all."""
    for name, rows in parsed(files, buckets, per_file).items():
        written(rows, f"{folder}/{name}", "errorifexists")
    link(files.sparkSession, folder, per_symbol)


def changes(spark: SparkSession, folder: str, listing: DataFrame) -> DataFrame:
    """(path, bucket, state): what is new, changed or gone since the index was written; listing has path, size_bytes, mtime_ms."""
    old = read(spark, folder, "files").select("path", "bucket", F.col("size_bytes").alias("s"), F.col("mtime_ms").alias("m"))
    both = listing.select("path", "size_bytes", "mtime_ms").join(old, "path", "full_outer")
    state = F.when(F.col("s").isNull(), "new").when(F.col("size_bytes").isNull(), "gone").when((F.col("s") != F.col("size_bytes")) | (F.col("m") != F.col("mtime_ms")), "changed")
    return both.select("path", "bucket", state.alias("state")).filter("state is not null")


def update(files: DataFrame, folder: str, buckets: int = BUCKETS, per_file: int | None = C.PER_FILE, per_symbol: int | None = PER_SYMBOL) -> dict[str, int]:
    """Bring the index up to date with files (path, text, size_bytes, mtime_ms); how many files were new, changed and gone.

    `buckets` must be what the index was built with. Texts of files that have not changed are not used.
    """
    spark = files.sparkSession
    found = saved(changes(spark, folder, files).withColumn("bucket", F.coalesce("bucket", bucket_of(F.col("path"), buckets))))
    counts = {r["state"]: r["n"] for r in found.groupBy("state").agg(F.count("*").alias("n")).collect()}
    if counts:
        due = files.join(found.filter("state <> 'gone'").select("path"), "path", "left_semi")
        touched = [r["bucket"] for r in found.select("bucket").distinct().collect()]  # a number for each bucket
        fresh = parsed(due, buckets, per_file)
        for name in TABLES:
            kept = read(spark, folder, name).filter(F.col("bucket").isin(touched)).join(found.select("path"), "path", "left_anti")
            rows = saved(kept.unionByName(fresh[name]))
            written(rows, f"{folder}/{name}", "overwrite")
            emptied = sorted(set(touched) - {r["bucket"] for r in rows.select("bucket").distinct().collect()})
            for b in emptied:  # nothing is left to overwrite it with
                place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/bucket={b}")
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            spark.catalog.refreshByPath(f"{folder}/{name}")
        link(spark, folder, per_symbol)
    return {k: counts.get(k, 0) for k in ("new", "changed", "gone")}


def joined_path(folder: Column, target: Column) -> Column:
    """target seen from a folder, without `.` and `..`."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), target), "/"), lambda x: ~x.isin("", "."))
    up = lambda a: (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), a), -1) != "..")
    step = lambda a, x: F.when((x == "..") & up(a), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with resolved_path: of a relative target the first of base, base with an ending, index in it; else a Python module."""
    local = F.col("target").startswith(".")
    base = joined_path(folder_of(F.col("path")), F.col("target"))
    ways = F.concat(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat("base", e)), F.transform(F.array(*map(F.lit, ENDINGS[1:])), lambda e: F.concat("base", F.lit("/index"), e)))
    module = F.array(F.concat(F.regexp_replace("target", r"\.", "/"), F.lit(".py")))
    # many files import the same: each place that is meant is sought once
    keyed = imports.withColumns({"local": local, "base": F.when(local, base).otherwise(""), "module": F.get(module, F.lit(0))})
    each = keyed.select("local", "base", "module").distinct()
    each = each.select("local", "base", "module", F.posexplode(F.when(F.col("local"), F.concat(ways, F.array("module"))).otherwise(F.array("module"))).alias("place", "way"))
    found = each.join(files.select(F.col("path").alias("way")), "way").groupBy("local", "base", "module").agg(F.min_by("way", "place").alias("resolved_path"))
    return keyed.join(found, ["local", "base", "module"], "left").select(*imports.columns, "resolved_path")


def references(tokens: DataFrame, symbols: DataFrame, per_symbol: int | None) -> DataFrame:
    """(symbol, path, line): lines that name a symbol and do not define it, the first of each in the order of paths."""
    named = symbols.filter(F.col("kind").isin(*REFERRED) & F.col("name").rlike(f"^{TOKEN}$")).select(F.col("name").alias("symbol"), "path", "line").distinct()
    names = named.select("symbol").distinct()
    uses = marked(tokens.withColumnRenamed("token", "symbol"), names, "symbol").join(names, "symbol").join(named, ["symbol", "path", "line"], "left_anti").select("symbol", "path", "line")
    if per_symbol is None:
        return uses
    return uses.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy("path", "line"))).filter(F.col("rank") <= per_symbol).drop("rank")


def link(spark: SparkSession, folder: str, per_symbol: int | None) -> None:
    """Write what joins the tables: imports with their targets, and references."""
    tables = {k: read(spark, folder, k) for k in TABLES}
    resolved(tables["imports"].drop("bucket"), tables["files"]).write.mode("overwrite").parquet(f"{folder}/resolved")
    references(tables["tokens"].drop("bucket"), tables["symbols"], per_symbol).write.mode("overwrite").parquet(f"{folder}/references")
    for name in ("resolved", "references"):
        spark.catalog.refreshByPath(f"{folder}/{name}")


def status(spark: SparkSession, folder: str, listing: DataFrame) -> DataFrame:
    """One row: fresh or stale, and the index's counts; a file is stale if its size or time differs or it is gone."""
    stale = changes(spark, folder, listing).agg(F.count_if(F.col("state") != "new").alias("stale_files"))
    sums = read(spark, folder, "files").agg(F.count("*").alias("files_indexed"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols_indexed"), F.coalesce(F.sum("imports"), F.lit(0)).alias("imports_indexed"))
    dynamic = read(spark, folder, "imports").agg(F.count_if(F.col("kind") == "dynamic_import").alias("dynamic_imports_indexed"))
    uses = read(spark, folder, "references").agg(F.count("*").alias("references_indexed"))
    one = sums.crossJoin(dynamic).crossJoin(uses).crossJoin(stale)  # single rows
    return one.select(F.when(F.col("stale_files") > 0, "stale").otherwise("fresh").alias("status"), "*")
