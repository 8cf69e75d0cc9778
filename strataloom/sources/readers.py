"""Readers: JSON lines, text lines, repositories, version-control listings, lockfiles, scanner reports, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import predicates as P
from strataloom.functions.text import extension

SKIPPED_DIRS = (".git", "node_modules", "dist", "build", "coverage", ".next", ".turbo", "tmp", ".cache")  # fixed
EVENT_SCHEMA = "ts timestamp, event_type string, session_id string, task_id string, surface string, source string, status string, tool_name string, ok boolean, uncertainty double, duration_ms double, raw_tokens_estimate long, compact_tokens_estimate long, saved_tokens_estimate long"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; bad lines are dropped, a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    if not exists(spark, path):
        return None
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def repository(spark: SparkSession, root: str, extensions: tuple[str, ...] = P.CODE_EXTENSIONS + P.DOC_EXTENSIONS, most_bytes: int | None = 512_000, most_files: int | None = None) -> DataFrame:
    """(path, ext, size, text) below a folder, in path order: known extensions, no skipped folders, no binary files; the first most_files, if given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", "[.]") + "/", "")
    out = files.select(path.alias("path"), F.col("length").alias("size"), "content")
    out = out.filter(F.col("size") <= most_bytes) if most_bytes else out
    out = out.withColumn("ext", extension(F.col("path"))).filter(F.col("ext").isin(*extensions) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_DIRS))))
    out = out.withColumn("text", F.decode("content", "UTF-8")).filter(~F.contains("text", F.lit("\0"))).drop("content")
    out = out.orderBy("path")
    return out.limit(most_files) if most_files else out


def under(files: DataFrame, roots: tuple[str, ...], explicit: DataFrame | None = None) -> DataFrame:
    """Files below some folders, or those that are named (path)."""
    inside = F.lit(False)
    for r in roots:
        inside = inside | F.col("path").startswith(r.rstrip("/") + "/")
    return files.filter(inside) if explicit is None else files.join(explicit.select("path").distinct(), "path", "left_semi")


def gate_files(files: DataFrame, most_files: int | None = None) -> DataFrame:
    """All files ranked: code and docs, others, generated; the first most_files, if given."""
    plain = F.when(P.category(F.col("path")).isin("code", "docs"), 0).otherwise(1)
    return files.withColumn("rank", plain + F.when(P.is_generated(F.col("path")), 2).otherwise(0)).orderBy("rank", "path").limit(most_files or 2**31 - 1)


def git_log(lines: DataFrame) -> DataFrame:
    """Lines of hash, short hash, time and subject, parted by tabs; a subject may hold tabs."""
    p = F.split("line", "\t", 4)
    return lines.filter(F.size(p) >= 4).select(p[0].alias("hash"), p[1].alias("short_hash"), F.to_timestamp(p[2]).alias("at"), p[3].alias("subject"))


def git_name_status(lines: DataFrame) -> DataFrame:
    """Status and path; renames and copies have the old path, too."""
    p = F.split("line", "\t")
    moved = F.substring(p[0], 1, 1).isin("R", "C")
    return lines.filter(F.size(p) >= 2).select("hash", F.substring(p[0], 1, 1).alias("status"), F.when(moved, F.get(p, F.lit(2))).otherwise(p[1]).alias("path"), F.when(moved, p[1]).alias("old_path"))


def git_numstat(lines: DataFrame) -> DataFrame:
    """Added and deleted lines; what is no number (binary files) counts 0."""
    p = F.split("line", "\t", 3)
    n = lambda i: F.coalesce(p[i].try_cast("int"), F.lit(0))
    return lines.filter(F.size(p) == 3).select(p[2].alias("path"), n(0).alias("added"), n(1).alias("deleted"))


def git_blame(lines: DataFrame) -> DataFrame:
    """Porcelain blame: one row a source line with the last header's hash and author (file, n, line)."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^([0-9a-f]{40}) \d+ (\d+)", 1)
    rows = lines.select("file", "n", F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(w).alias("hash"), F.last(F.nullif(F.regexp_extract("line", r"^[0-9a-f]{40} \d+ (\d+)", 1), F.lit("")), ignorenulls=True).over(w).alias("at"), "line")
    names = rows.filter(F.col("line").startswith("author ")).select("hash", F.substring("line", 8, 1000).alias("author")).groupBy("hash").agg(F.first("author").alias("author"))
    return rows.filter(F.col("line").startswith("\t")).join(names, "hash", "left").select("file", F.col("at").cast("int").alias("line"), "hash", "author")


def lockfile(raw: Column) -> Column:
    """Packages of a lockfile's JSON, as an array in the order of names; both layouts."""
    fields = "struct<version:string,dev:boolean,optional:boolean,license:string,resolved:string,integrity:string,hasInstallScript:boolean>"
    parsed = F.from_json(raw, f"struct<packages:map<string,{fields}>,dependencies:map<string,{fields}>>")
    new = F.filter(F.map_entries(parsed["packages"]), lambda e: e["key"].contains("node_modules/"))
    both = F.when(F.size(F.coalesce(new, F.array())) > 0, new).otherwise(F.map_entries(parsed["dependencies"]))
    return F.array_sort(F.transform(both, lambda e: F.struct(F.element_at(F.split(e["key"], "node_modules/"), -1).alias("name"), e["value"]["version"].alias("version"), F.coalesce(e["value"]["dev"], F.lit(False)).alias("dev"), e["value"]["license"].alias("license"), e["value"]["resolved"].alias("resolved"), e["value"]["integrity"].alias("integrity"), F.coalesce(e["value"]["hasInstallScript"], F.lit(False)).alias("has_install_script"))))


def json_prelude(raw: Column) -> Column:
    """The text from the first bracket on, for reports with a log in front; null if there is none."""
    places = F.array(*(F.when(F.instr(raw, b) > 0, F.instr(raw, b)) for b in ("{", "[")))
    at = F.array_min(places)
    return F.when(at.isNotNull(), F.substr(raw, at))


def sarif(raw: DataFrame) -> DataFrame:
    """Findings of SARIF reports (report_id, raw)."""
    schema = "struct<runs:array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>>>>>>"
    runs = raw.select("report_id", F.explode(F.from_json("raw", schema)["runs"]).alias("r"))
    found = runs.select("report_id", F.col("r.tool.driver.name").alias("source"), F.explode("r.results").alias("x"))
    at = F.get(F.col("x.locations"), F.lit(0))["physicalLocation"]
    return found.select("report_id", "source", at["artifactLocation"]["uri"].alias("file"), at["region"]["startLine"].alias("line"), at["region"]["startColumn"].alias("column"), F.col("x.message.text").alias("message"), F.col("x.ruleId").alias("rule_id"), F.coalesce("x.level", F.lit("warning")).alias("severity"))


def npm_audit(raw: DataFrame) -> DataFrame:
    schema = "struct<vulnerabilities:map<string,struct<severity:string,isDirect:boolean,range:string>>>"
    return raw.select("report_id", F.explode(F.from_json("raw", schema)["vulnerabilities"]).alias("package", "v")).select("report_id", "package", "v.severity", F.coalesce("v.isDirect", F.lit(False)).alias("is_direct"), "v.range")


def osv(raw: DataFrame) -> DataFrame:
    schema = "struct<results:array<struct<packages:array<struct<package:struct<name:string,version:string>,vulnerabilities:array<struct<id:string,aliases:array<string>>>>>>>>"
    a = raw.select("report_id", F.explode(F.from_json("raw", schema)["results"]).alias("r")).select("report_id", F.explode("r.packages").alias("p"))
    return a.select("report_id", "p.package.name", "p.package.version", F.explode("p.vulnerabilities").alias("v")).select("report_id", "name", "version", F.col("v.id").alias("vuln_id"), "v.aliases")


def console_lines(lines: DataFrame) -> DataFrame:
    kind = F.lower(F.regexp_extract("line", r"(?i)\b(error|warning|warn|info|log|debug)\b", 1))
    return lines.filter(kind != "").select("*", F.when(kind == "warn", "warning").otherwise(kind).alias("type"))


def network_lines(lines: DataFrame) -> DataFrame:
    pattern = r"\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(\S+)\s+(\d{3})\b"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.filter(part(1) != "").select("*", part(1).alias("method"), part(2).alias("url"), part(3).cast("int").alias("status"))


def ocr_table(lines: DataFrame) -> DataFrame:
    """Text and mean confidence of recognised words, from twelve columns parted by tabs."""
    p = F.split("line", "\t")
    conf = F.get(p, F.lit(10)).try_cast("double")
    rows = lines.filter((F.size(p) >= 12) & (conf >= 0) & (F.trim(F.get(p, F.lit(11))) != "")).select("image", "n", conf.alias("conf"), F.trim(F.get(p, F.lit(11))).alias("word"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]), " ")
    return rows.groupBy("image").agg(words.alias("text"), (F.avg("conf") / 100).alias("confidence"))


def npm_fix_plan(reports: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """A row a vulnerable package of a dry-run fix plan, with the plan's net change in packages."""
    schema = "struct<added:int,removed:int,audit:string,vulnerabilities:string>"
    package = "map<string,struct<severity:string,isDirect:boolean,range:string,via:array<string>,effects:array<string>,fixAvailable:string>>"
    top = reports.select(key, F.from_json(raw, schema).alias("p"))
    inner = F.coalesce(F.get_json_object("p.audit", "$.vulnerabilities"), F.col("p.vulnerabilities"))
    net = F.coalesce("p.added", F.lit(0)) - F.coalesce("p.removed", F.lit(0))
    rows = top.select(key, net.alias("net"), F.explode(F.from_json(inner, package)).alias("package", "v"))
    fix, size = F.col("v.fixAvailable"), lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0))
    of = lambda k: F.get_json_object(fix, f"$.{k}")
    return rows.select(
        key, "package", F.coalesce("v.severity", F.lit("unknown")).alias("severity"), F.coalesce("v.isDirect", F.lit(False)).alias("direct"), F.greatest(F.lit(0), size(F.col("v.via"))).alias("via"), F.greatest(F.lit(0), size(F.col("v.effects"))).alias("effects"),
        F.col("v.range").alias("range"), F.coalesce(~fix.isin("false", "null", "0", ""), F.lit(False)).alias("fix_available"), of("name").alias("fix_package"), of("version").alias("fix_version"), F.coalesce(of("isSemVerMajor") == "true", F.lit(False)).alias("fix_major"), "net",
    )


def mirror_manifest(manifests: DataFrame, raw: str = "raw") -> DataFrame:
    """(source_path, title, page_id_hash, url_hash, source_hash, last_synced_at) of the pages of mirror manifests; ids only as hashes."""
    from strataloom.functions.text import stable_hash

    page = "array<struct<source_path:string,title:string,notion_page_id:string,notion_url:string,source_hash:string,last_synced_at:string>>"
    pages = F.coalesce(F.from_json(raw, f"struct<pages:{page}>")["pages"], F.from_json(raw, page))
    rows = manifests.select(F.explode(pages).alias("p")).filter("p.source_path is not null")
    return rows.select("p.source_path", F.substring("p.title", 1, 120).alias("title"), stable_hash(F.col("p.notion_page_id")).alias("page_id_hash"), stable_hash(F.col("p.notion_url")).alias("url_hash"), "p.source_hash", "p.last_synced_at")


def benchmark_runs(reports: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, compressor, fixture, run, b): byte savings of the samples `fixture#rN` of compressor benchmarks; other samples are left out."""
    sample = "array<struct<sample_id:string,ratio:double>>"
    top = reports.select(key, F.from_json(raw, f"struct<compressor:string,per_sample:{sample}>").alias("d")).select(key, "d.compressor", F.explode("d.per_sample").alias("s"))
    part = lambda i: F.regexp_extract("s.sample_id", r"^(.+)#r(\d+)$", i)
    return top.filter(part(1) != "").select(key, "compressor", part(1).alias("fixture"), part(2).cast("int").alias("run"), (1 - F.col("s.ratio")).alias("b"))


def stable_fixtures(runs: DataFrame, key: str) -> DataFrame:
    """(key, compressor, fixture, runs, stable): whether two or more runs save the same."""
    return runs.groupBy(key, "compressor", "fixture").agg(F.count("*").alias("runs"), ((F.count("*") >= 2) & (F.max("b") - F.min("b") < 1e-9)).alias("stable"))
