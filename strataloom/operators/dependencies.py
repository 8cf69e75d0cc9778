"""Declared packages without evidence of use, for every package file of a tree of files (path, text).

Evidence is looked for below a package file's folder: imports over whole texts (also over line ends, and style sheets'),
type packages of what is used, compiler and style tools by their files, names in scripts, code and configuration,
programs that scripts call, and packages that a used package asks for. Names meet texts by equality: a mention is a run
of name characters, or what stands before an `@` in it, so each text is cut once whatever the number of names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import extension
from strataloom.operators.code import package_name
from strataloom.session import saved, spread

# Patterns, file names, kinds of dependencies.
IMPORT = (
    r"""\bimport\s+(?:type\s+)?(?:[^'"()]*?\s+from\s+)?["']([^"']+)["']|\bexport\s+[^"']*?\s+from\s+["']([^"']+)["']"""
    r"""|\brequire\(\s*["']([^"']+)["']\s*\)|\bimport\(\s*["'`]([^"'`]+)["'`]\s*\)"""
)
STYLE_IMPORT = r"""@import\s+(?:url\(\s*)?["']([^"')]+)["']"""
KINDS = ("import", "export", "require", "dynamic_import")
CODE = (".astro", ".cjs", ".css", ".go", ".js", ".jsx", ".mjs", ".php", ".py", ".rs", ".scss", ".ts", ".tsx")
CONFIGURATION = ("tsconfig", "next.config", "postcss.config", "tailwind.config", "vite.config", "eslint.config")
LOCKS = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb")
TYPES = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
NAME_RUN = "[A-Za-z0-9@_./-]+"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def imports_of(files: DataFrame) -> DataFrame:
    """(path, kind, specifier) of every import, export from, require and style import of whole texts."""
    groups = lambda x: F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract(x, IMPORT, i + 1).alias("specifier")) for i, k in enumerate(KINDS)))
    text = F.coalesce("text", F.lit(""))
    code = F.filter(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(IMPORT), F.lit(0)), groups)), lambda r: r["specifier"] != "")
    style = F.transform(F.regexp_extract_all(text, F.lit(STYLE_IMPORT), F.lit(1)), lambda x: F.struct(F.lit("import").alias("kind"), x.alias("specifier")))
    return files.select("path", F.inline(F.concat(code, style)))


def mentions(text: Column) -> Column:
    """The names that a text can mention: runs of name characters, and what stands in them before an `@`."""
    before = lambda r: F.transform(F.sequence(F.lit(1), F.size(F.split(r, "@"))), lambda i: F.concat_ws("@", F.slice(F.split(r, "@"), 1, i)))
    runs = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NAME_RUN), F.lit(0)))
    plain, marked = F.filter(runs, lambda r: ~r.contains("@")), F.filter(runs, lambda r: r.contains("@"))
    return F.filter(F.array_distinct(F.concat(plain, F.flatten(F.transform(marked, before)))), lambda x: x != "")


def below(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (path, ...) once for each package folder (root) that they lie in."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return rows.withColumn("root", F.explode(above)).join(roots, "root")


def declared(files: DataFrame) -> DataFrame:
    """(root, package_file, dependency_type, dependency_name, scripts) of package files; one that is no JSON declares nothing."""
    maps = ", ".join(f"{k}: map<string, string>" for k in (*TYPES, "scripts"))
    rows = files.filter(base_name(F.col("path")) == "package.json").select("path", F.from_json("text", f"struct<{maps}>").alias("p")).filter("p is not null")
    each = F.array(*(F.struct(F.lit(k).alias("dependency_type"), F.coalesce(F.map_keys(f"p.{k}"), F.array().cast("array<string>")).alias("names")) for k in TYPES))
    scripts = F.array_join(F.coalesce(F.map_values("p.scripts"), F.array().cast("array<string>")), "\n")
    rows = rows.select(folder_of(F.col("path")).alias("root"), F.col("path").alias("package_file"), scripts.alias("scripts"), F.explode(each).alias("d"))
    return rows.select("root", "package_file", "scripts", "d.dependency_type", F.explode_outer("d.names").alias("dependency_name"))


def lock_facts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of lock files: the programs (root, package, program) and the wants (root, package, wanted) of installed packages."""
    rows = files.filter(base_name(F.col("path")) == "package-lock.json").select(folder_of(F.col("path")).alias("root"), F.try_parse_json("text").alias("v"))
    rows = rows.select("root", F.explode(F.try_variant_get("v", "$.packages", "map<string, variant>")).alias("place", "facts"))
    inner = F.when(F.col("place").contains("node_modules/"), F.substring_index("place", "node_modules/", -1))
    rows = rows.select("root", package_name(inner).alias("package"), "facts").filter("package <> ''")
    own = F.when(F.col("package").startswith("@"), F.substring_index("package", "/", -1)).otherwise(F.col("package"))
    kind = F.schema_of_variant(F.try_variant_get("facts", "$.bin", "variant"))
    several = F.map_keys(F.try_variant_get("facts", "$.bin", "map<string, variant>"))
    programs = rows.select("root", "package", F.explode(F.when(kind == "STRING", F.array(own)).otherwise(several)).alias("program"))
    return programs, rows.select("root", "package", F.explode(F.map_keys(F.try_variant_get("facts", "$.peerDependencies", "map<string, variant>"))).alias("wanted"))


def unused_dependencies(files: DataFrame) -> DataFrame:
    """(package_file, dependency_name, dependency_type, confidence): declared packages that nothing shows to be in use.

    A name with other characters than letters, digits and `@_./-` is only found in imports. Texts that are null or no
    JSON where JSON is due count as empty. Repeated paths do no harm.
    """
    files = saved(spread(files.select("path", "text")))  # read six times, and what makes it only once
    path, name = F.col("path"), base_name(F.col("path"))
    given = saved(declared(files))
    roots = given.select("root").distinct()
    wanted = given.filter("dependency_name is not null").select("root", F.col("dependency_name").alias("name")).distinct()
    is_code = F.lower(extension(path)).isin(*CODE)
    configured = reduce(lambda a, b: a | b, (F.lower(name).startswith(x) for x in CONFIGURATION))
    imported = below(imports_of(files.filter(is_code)).select("path", package_name(F.col("specifier")).alias("name")).filter("name <> ''").distinct(), roots)
    imported = saved(imported.select("root", "name").distinct())
    typed = F.lower(extension(path)).isin(".ts", ".tsx") | name.startswith("tsconfig")
    tools = below(files.select("path", typed.alias("typed"), F.lower(name).startswith("postcss.config").alias("styled")).filter("typed or styled"), roots)
    tools = saved(tools.groupBy("root").agg(F.max("typed").alias("typed"), F.max("styled").alias("styled")))

    texts = below(files.filter((is_code | configured) & ~name.isin(*LOCKS)).select("path", F.explode(mentions(F.col("text"))).alias("name")).join(wanted.select("name").distinct(), "name"), roots)
    called = given.select("root", "scripts").distinct().select("root", F.explode(mentions(F.col("scripts"))).alias("name")).distinct()
    mentioned = texts.select("root", "name").unionByName(called).join(wanted, ["root", "name"])
    programs, wants = lock_facts(files)
    run = programs.join(called.withColumnRenamed("name", "program"), ["root", "program"]).select("root", F.col("package").alias("name"))
    shown = saved(mentioned.unionByName(run).distinct())

    providers = imported.unionByName(shown.join(wanted, ["root", "name"])).distinct().withColumnRenamed("name", "package")
    asked = wants.join(providers, ["root", "package"]).select("root", F.col("wanted").alias("name"))
    known = imported.unionByName(wanted).distinct().withColumnRenamed("name", "runtime")
    raw = F.substring("name", 8, 300)
    of_types = wanted.filter(F.col("name").startswith("@types/")).withColumn("runtime", F.when(raw.contains("__"), F.concat(F.lit("@"), F.regexp_replace(raw, "^(.*?)__", "$1/"))).otherwise(raw))
    of_types = of_types.join(tools.filter("typed").select("root"), "root")
    of_types = of_types.filter("runtime = 'node'").select("root", "name").unionByName(of_types.join(known, ["root", "runtime"]).select("root", "name"))
    of_tools = tools.select("root", F.explode(F.array_compact(F.array(F.when(F.col("typed"), F.lit("typescript")), F.when(F.col("styled"), F.lit("postcss"))))).alias("name"))
    used = reduce(DataFrame.unionByName, (imported, shown, asked, of_types, of_tools)).distinct()
    left = given.filter("dependency_name is not null").join(used.withColumnRenamed("name", "dependency_name"), ["root", "dependency_name"], "left_anti")
    confidence = F.when(F.col("dependency_type") == "dependencies", 0.65).otherwise(0.5)
    return left.select("package_file", "dependency_name", "dependency_type", confidence.alias("confidence")).distinct()
