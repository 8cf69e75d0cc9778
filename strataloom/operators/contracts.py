"""Contracts in source trees: environment variables, schemas written in code, API descriptions, payload checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions.yaml import as_json
from strataloom.session import spread

# Patterns of names and declarations.
NAME = "[A-Z][A-Z0-9_]{1,}"
USES = (rf"process\.env\.({NAME})", rf"process\.env\[['\"]({NAME})['\"]\]")
UNPACKED = r"\b(?:const|let|var)\s*\{([^}]+)\}\s*=\s*process\.env\b"
OBJECTS = {"const_object": r"(?:export\s+)?const\s+([A-Za-z0-9_]+)\s*=\s*z\.object\s*\(", "embedded_object": r"([A-Za-z_][A-Za-z0-9_]*)\s*:\s*z\.object\s*\("}
FIELD = r"([A-Za-z_][A-Za-z0-9_]*)\s*:\s*([^,\n]+(?:\([^)]*\))?[^,\n]*)"
OPTIONAL = r"\.(?:optional|nullish|nullable)\s*\("
TYPE = r"z\.(string|number|boolean|array|object|enum|literal|date|record|unknown|any|nativeEnum)"
METHODS = ("get", "post", "put", "patch", "delete", "options", "head")


def _sorted_set(names: Column) -> Column:
    return F.array_sort(F.array_distinct(names))


def env_declarations(text: Column) -> Column:
    """Names that an environment file sets, sorted."""
    lines = F.filter(F.transform(T.lines_of(text), T.trim), lambda x: ~x.startswith("#"))
    bare = F.transform(lines, lambda x: F.when(x.startswith("export "), T.trim(F.substr(x, F.lit(8)))).otherwise(x))
    return _sorted_set(F.filter(F.transform(bare, lambda x: F.regexp_extract(x, rf"^({NAME})\s*=", 1)), lambda x: x != ""))


def env_uses(text: Column) -> Column:
    """Names that code reads, sorted: as a property, by index, or unpacked."""
    direct = F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in USES))
    items = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(UNPACKED), 1), lambda body: F.split(body, ",")))
    names = F.transform(items, lambda x: T.trim(F.substring_index(T.trim(x), ":", 1)))
    return _sorted_set(F.concat(direct, F.filter(names, lambda x: x.rlike(f"^{NAME}$"))))


# --- schemas in code ----------------------------------------------------------------------------


def _bodies(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """For each text the schema objects in it: (kind, name, place, body between the braces that belong together)."""
    starts = [(kind, re.compile(p, re.A)) for kind, p in OBJECTS.items()]
    braces = re.compile("[{}]")
    for series in texts:
        out = []
        for text in series:
            text, own = text or "", []
            ends, opened = {}, []
            for m in braces.finditer(text):  # once a text: where each opened brace is closed
                if m[0] == "{":
                    opened.append(m.start())
                elif opened:
                    ends[opened.pop()] = m.start()
            for kind, pattern in starts:
                for m in pattern.finditer(text):
                    at = text.find("{", m.start())
                    if at in ends:
                        own.append({"schema_kind": kind, "schema_name": m[1], "place": m.start() + 1, "body": text[at + 1 : ends[at]]})
            out.append(own)
        yield pd.Series(out)


def code_schemas(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, schema_kind, schema_name, line, field_name, optional, type_hint), a row a field, of object schemas written in code.

    Only matching braces needs Python (an Arrow batch at a time); fields are read by expressions.
    """
    bodies = F.pandas_udf(_bodies, "array<struct<schema_kind:string,schema_name:string,place:int,body:string>>")
    rows = files.filter(F.col(text).rlike(r"\bz\b")).select(path, text, F.explode(bodies(F.col(text))).alias("s"))
    line = F.size(T.lines_of(F.substring(F.col(text), F.lit(1), F.col("s.place") - 1)))
    rows = rows.select(path, "s.schema_kind", "s.schema_name", line.alias("line"), F.col("s.body").alias("body")).dropDuplicates([path, "line", "schema_kind", "schema_name"])
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(FIELD), 1).alias("name"), F.regexp_extract_all("body", F.lit(FIELD), 2).alias("expr"))
    rows = rows.select(path, "schema_kind", "schema_name", "line", F.explode(F.filter(pairs, lambda p: p["name"] != "z")).alias("f"))
    hint = F.coalesce(F.nullif(F.regexp_extract("f.expr", TYPE, 1), F.lit("")), F.lit("unknown"))
    return rows.select(path, "schema_kind", "schema_name", "line", F.col("f.name").alias("field_name"), F.col("f.expr").rlike(OPTIONAL).alias("optional"), hint.alias("type_hint"))


# --- API descriptions ---------------------------------------------------------------------------

REF = "struct<schema:struct<`$ref`:string>>"
OPERATION = f"operationId string, parameters array<struct<required:boolean>>, requestBody struct<content:map<string,{REF}>>, responses map<string,struct<content:map<string,{REF}>>>"


def schema_ref(ref: Column) -> Column:
    """The last part of a reference."""
    return F.substring_index(ref, "/", -1)


def _first_ref(contents: Column) -> Column:
    """The first reference in a list of media maps."""
    refs = F.flatten(F.transform(contents, lambda c: F.transform(F.map_values(c), lambda m: m["schema"]["$ref"])))
    return schema_ref(F.get(F.filter(refs, lambda x: x.isNotNull()), F.lit(0)))


def _described(files: DataFrame, path: str, text: str, shape: str) -> DataFrame:
    """(path, d): the texts that are API descriptions, read as `shape`.

    Exploded, since a filter would be pushed in front of the dealing and read all texts there, in one task and once more.
    """
    read = F.explode(F.array(F.from_json(as_json(F.col(text)), shape)))
    return spread(files.select(path, text)).select(path, read.alias("d")).filter("coalesce(d.openapi, d.swagger) is not null")


def api_operations(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, method, path_template, operation_id, required_params, request_schema, response_schema) of API descriptions in JSON or YAML."""
    rows = _described(files, path, text, "openapi string, swagger string, paths map<string,map<string,string>>")
    rows = rows.select(path, F.explode("d.paths").alias("path_template", "item")).select(path, "path_template", F.explode("item").alias("method", "raw"))
    rows = rows.filter(F.lower("method").isin(*METHODS) & F.ltrim("raw").startswith("{")).withColumn("op", F.from_json("raw", OPERATION))
    known = lambda x: F.filter(x, lambda c: c.isNotNull())
    required = F.size(F.filter(F.coalesce(F.col("op.parameters"), F.array()), lambda p: p["required"]))
    responses = F.coalesce(F.transform(F.map_values("op.responses"), lambda r: r["content"]), F.array())
    return rows.select(
        path, F.upper("method").alias("method"), "path_template", F.col("op.operationId").alias("operation_id"), required.alias("required_params"),
        _first_ref(known(F.array("op.requestBody.content"))).alias("request_schema"), _first_ref(known(responses)).alias("response_schema"),
    )


def api_schemas(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, schema_name, type, properties, required) of the named schemas of API descriptions in JSON or YAML."""
    shape = "openapi string, swagger string, components struct<schemas:map<string,struct<type:string,required:array<string>,properties:map<string,string>>>>"
    rows = _described(files, path, text, shape).select(path, F.explode("d.components.schemas").alias("schema_name", "s"))
    return rows.select(path, "schema_name", F.col("s.type").alias("type"), F.coalesce(F.size("s.properties"), F.lit(0)).alias("properties"), F.array_sort(F.coalesce("s.required", F.array().cast("array<string>"))).alias("required"))


def structured(text: Column, path: Column) -> Column:
    """A JSON or YAML file as a variant; null for what is neither or has another ending."""
    name = F.lower(path)
    return F.when(name.endswith(".json"), F.try_parse_json(text)).when(name.rlike(r"\.ya?ml$"), F.try_parse_json(as_json(text)))


# --- payloads -----------------------------------------------------------------------------------

#: JSON Schema's type names, and how the schema of a variant begins for them.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}


def payload_problems(payload: Column, schema: dict, at: str = "$") -> Column:
    """All places where a JSON text breaks a schema (type, required, enum, minimum, maximum, nested properties and items)."""
    value = F.try_parse_json(payload)
    return F.when(value.isNull(), F.array(F.lit(f"{at}: no JSON"))).otherwise(_problems(value, schema, at))


def _problems(value: Column, schema: dict, at: str) -> Column:
    kind = F.schema_of_variant(value)
    found = []
    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        fits = F.lit(False)
        for name in wanted:
            for start in KINDS[name]:
                fits = fits | kind.startswith(start)
        found.append(F.array(F.when(~fits, F.lit(f"{at}: is not {' or '.join(wanted)}"))))
    if "enum" in schema:
        found.append(F.array(F.when(~F.to_json(value).isin(*(_json(x) for x in schema["enum"])), F.lit(f"{at}: is none of the allowed values"))))
    for name, fails in (("minimum", lambda x, y: x < y), ("maximum", lambda x, y: x > y)):
        if name in schema:
            number = F.try_variant_get(value, "$", "double")
            found.append(F.array(F.when(~kind.startswith("STRING") & fails(number, float(schema[name])), F.lit(f"{at}: is beyond the {name}"))))
    for name in schema.get("required", []):
        missing = kind.startswith("OBJECT") & F.try_variant_get(value, f"$['{name}']", "variant").isNull()
        found.append(F.array(F.when(missing, F.lit(f"{at}.{name}: is required"))))
    for name, inner in schema.get("properties", {}).items():
        child = F.try_variant_get(value, f"$['{name}']", "variant")
        found.append(F.when(kind.startswith("OBJECT") & child.isNotNull(), _problems(child, inner, f"{at}.{name}")).otherwise(F.array().cast("array<string>")))
    if "items" in schema:
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        found.append(F.when(kind.startswith("ARRAY"), F.flatten(F.transform(items, lambda x: _problems(x, schema["items"], f"{at}[]")))).otherwise(F.array().cast("array<string>")))
    return F.array_compact(F.concat(*(f.cast("array<string>") for f in found))) if found else F.array().cast("array<string>")


def _json(x: object) -> str:
    import json

    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))
