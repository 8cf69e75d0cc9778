"""What may leave a workspace or be changed in it: leak scans, safe samples, edits that need a test, rejected callers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys and texts that an export must not hold, keys that a sample loses, and how a policy refuses.
FORBIDDEN_KEYS = (
    "query", "corrected_query", "notes", "request_log_path", "feedback_log_path", "expected_paths", "missing_paths", "retrieved_paths", "opened_paths", "high_uncertainty_samples", "candidate_samples",
    "returned_paths", "error_samples", "raw_search_url", "compact_context_url", "artifact_url",
)
FORBIDDEN_VALUES = ("/Users/", "requests.jsonl", "feedback.jsonl", "raw_search", "compact_context_url")
UNSAFE_KEY = r"(?i)^(?:query|notes|text)$|_text$|body|content|path"
MOST_SAMPLED = 20
REFUSED = r"(?i)\bis not allowed\b|not an allowed host|allowed hosts:|\bssrf\b|disallowed (?:host|url)|invalid (?:url|image url)|must be (?:https?|a valid)|url is not (?:http|https|allowed)"
NO_CODE = r"(?i)\.(?:md|mdx|txt|json|ya?ml|toml|lock|css|scss|html?|svg|png|jpe?g|gif|sql|sh|env|cfg|ini)$"
CODE = r"(?i)\.(?:py|ts|tsx|js|jsx|mjs|cjs|go)$"
NOT_GATED = ("/generated/", "/migrations/", "/__generated__/", "/dist/", "/build/", "/node_modules/")


def _leaves(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Every key and every text value in each JSON text, with its dotted path."""
    for series in texts:
        out = []
        for text in series:
            found, todo = [], [("", json.loads(text))] if text else []
            while todo:
                at, value = todo.pop()
                inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
                for k, v in inner:
                    path = f"{at}.{k}" if at else str(k)
                    if isinstance(value, dict):
                        found.append({"path": path, "key": k, "value": None})
                    todo.append((path, v))
                if isinstance(value, str):
                    found.append({"path": at, "key": None, "value": value})
            out.append(found)
        yield pd.Series(out)


def leak_scan(exports: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, path, reason) of forbidden keys and values anywhere in JSON exports."""
    leaves = exports.select(key, F.explode(F.pandas_udf(_leaves, "array<struct<path:string,key:string,value:string>>")(F.col(raw))).alias("x")).select(key, "x.path", F.col("x.key").alias("_key"), "x.value")
    keys = leaves.filter(F.col("_key").isin(*FORBIDDEN_KEYS)).select(key, "path", F.concat(F.lit("forbidden_key:"), "_key").alias("reason"))
    values = leaves.filter("value is not null").select(key, "path", F.explode(F.array_compact(F.array(*(F.when(F.col("value").contains(v), F.lit(f"forbidden_value:{v}")) for v in FORBIDDEN_VALUES)))).alias("reason"))
    return keys.unionByName(values)


def _without(value: object, unsafe) -> object:
    if isinstance(value, dict):
        return {k: _without(v, unsafe) for k, v in value.items() if not unsafe.search(k)}
    return [_without(v, unsafe) for v in value[:MOST_SAMPLED]] if isinstance(value, list) else value


def _samples(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import re

    unsafe = re.compile(UNSAFE_KEY)
    for series in texts:
        yield series.map(lambda x: json.dumps(_without(json.loads(x), unsafe), ensure_ascii=False, separators=(",", ":")) if x else None)


def safe_sample(raw: Column) -> Column:
    """A JSON text without keys of texts, bodies and paths at any depth; a sample's lists have 20 items at most."""
    return F.pandas_udf(_samples, "string")(raw)


def is_caller_rejection(error: Column) -> Column:
    """A refusal by policy, which is no regression of the service."""
    return F.coalesce(error.rlike(REFUSED), F.lit(False))


def edit_checks(edits: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """(path, allowed, reason): an edit of gated code needs a test that names it in a tests folder beside it or one level up."""
    rows = edits.select(path).distinct()
    p = F.concat(F.lit("/"), F.col(path))
    skipped = reduce(lambda a, b: a | b, (p.contains(x) for x in NOT_GATED))
    reason = F.when(p.rlike(NO_CODE), "no code").when(~p.contains("/src/"), "not in src").when(skipped, "excluded path").when(~p.rlike(CODE), "no code")
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")
    rows = rows.select(path, reason.alias("reason"), stem.alias("stem"), F.array_distinct(F.array(folder, F.regexp_replace(folder, "/?[^/]*$", ""))).alias("roots"))
    # tests by the folder that holds their tests folder, and by the name they test
    inside = r"(?:^|/)(?:tests|test|__tests__)/"
    test = files.filter(F.col(path).rlike(inside)).select(F.regexp_extract(path, r"^(?:(.*?)/)?(?:tests|test|__tests__)/", 1).alias("root"), F.substring_index(path, "/", -1).alias("name"))
    names = test.select("root", F.regexp_replace(F.regexp_replace("name", r"\.[^.]+$", ""), r"^test_|[._](?:test|spec)$", "").alias("stem")).distinct()
    near = rows.filter("reason is null").select(path, "stem", F.explode("roots").alias("root"))
    has_folder = near.join(names.select("root").distinct(), "root", "left_semi").select(path).distinct().withColumn("folder", F.lit(True))
    has_test = near.join(names, ["root", "stem"], "left_semi").select(path).distinct().withColumn("tested", F.lit(True))
    out = rows.join(has_folder, path, "left").join(has_test, path, "left")
    why = F.coalesce("reason", F.when(F.col("tested"), "test found").when(F.col("folder").isNull(), "no tests folder").otherwise("no matching test"))
    return out.select(path, why.alias("reason")).withColumn("allowed", F.col("reason") != "no matching test")
