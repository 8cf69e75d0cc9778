"""Action receipts: validation, canonical JSON and its hash, and how often runs agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The action types of a receipt, and attributes that are noise in a DOM.
ACTIONS = ("click", "type", "press", "scroll", "wait", "navigate", "select", "drag")
NOISE_ATTRIBUTES = ("data-time", "data-timestamp", "data-frame", "data-focused")


def json_text(x: Column) -> Column:
    """A JSON string, null as null; non-ASCII characters stay."""
    return F.when(x.isNull(), "null").otherwise(_quoted(x))


def _quoted(x: Column) -> Column:
    whole = F.to_json(F.struct(x.alias("v")))
    return F.substring(whole, 6, F.length(whole) - 6)


def json_bool(x: Column) -> Column:
    return F.when(x.isNull(), "null").when(x, "true").otherwise("false")


def json_array(x: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(x, json_text), ", "), F.lit("]"))


def canonical_json(r: str = "receipt") -> Column:
    """Sorted keys, a blank behind colon and comma; without observability and region sizes."""
    f = lambda path: F.col(f"{r}.{path}")

    def member(pairs: list[tuple[str, Column]]) -> Column:
        parts = []
        for i, (k, v) in enumerate(sorted(pairs, key=lambda p: p[0])):
            parts += [F.lit(("" if i == 0 else ", ") + f'"{k}": '), v]
        return F.concat(F.lit("{"), *parts, F.lit("}"))

    return member(
        [
            ("schema_version", json_text(f("schema_version"))),
            ("action", member([(k, json_text(f(f"action.{k}"))) for k in ("type", "selector", "value")])),
            ("pre_state", member([(k, json_text(f(f"pre_state.{k}"))) for k in ("url", "dom_region_hash")])),
            ("post_state", member([*((k, json_text(f(f"post_state.{k}"))) for k in ("url", "dom_region_hash")), *((k, json_bool(f(f"post_state.{k}"))) for k in ("changed", "stable", "navigated"))])),
            ("errors", member([*((k, json_array(f(f"errors.{k}"))) for k in ("console", "network")), *((k, json_bool(f(f"errors.{k}"))) for k in ("selector_not_found", "timeout")), ("action_failed", json_text(f("errors.action_failed")))])),
        ]
    )


def problems(r: str = "receipt") -> Column:
    """What is missing or wrong, as an array."""
    f = lambda path: F.col(f"{r}.{path}")
    need = ["schema_version", "action.type", "pre_state.url", "pre_state.dom_region_hash", "post_state.url", "post_state.dom_region_hash", "post_state.changed", "post_state.stable", "post_state.navigated"]
    return F.array_compact(F.array(*(F.when(f(p).isNull(), F.lit(f"missing {p}")) for p in need), F.when(~f("action.type").isin(*ACTIONS), F.concat(F.lit("unknown action "), f("action.type")))))


def dom_hash(html: Column) -> Column:
    for name in NOISE_ATTRIBUTES:
        html = F.regexp_replace(html, f'\\s{name}="[^"]*"', "")
    return F.concat(F.lit("sha256:"), F.sha2(html, 256))


def modal_share(rows: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Share of the most frequent digest of each group, by two small aggregations."""
    per = rows.groupBy(*keys, digest).agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("runs"), (F.max("n") / F.sum("n")).alias("score"))


def suspicious(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Selectors whose region never reached 200 bytes, and hashes that never changed over three runs or more."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("runs"), F.max("size_bytes").alias("largest"), F.count_distinct("hash").alias("hashes"))
    return out.withColumns({"selector_miss": F.col("largest") < 200, "constant_hash": (F.col("runs") >= 3) & (F.col("hashes") == 1)})


def assemble(action: Column, pre_url: Column, pre_html: Column, post_url: Column, post_html: Column, navigated: Column | None = None, stable: Column | None = None, errors: Column | None = None) -> Column:
    """A receipt struct of what a browser saw: the regions' hashes and sizes, whether they differ, and an empty error block unless one is given."""
    own = lambda x, otherwise: F.coalesce(x, F.lit(otherwise)) if x is not None else F.lit(otherwise)
    before, after = dom_hash(pre_html), dom_hash(post_html)
    none = F.array().cast("array<string>")
    empty = F.struct(none.alias("console"), none.alias("network"), F.lit(False).alias("selector_not_found"), F.lit(False).alias("timeout"), F.lit(None).cast("string").alias("action_failed"))
    return F.struct(
        F.lit("1").alias("schema_version"), action.alias("action"),
        F.struct(pre_url.alias("url"), before.alias("dom_region_hash"), F.octet_length(pre_html).alias("dom_region_size_bytes")).alias("pre_state"),
        F.struct(post_url.alias("url"), after.alias("dom_region_hash"), F.octet_length(post_html).alias("dom_region_size_bytes"), (before != after).alias("changed"), own(stable, True).alias("stable"), own(navigated, False).alias("navigated")).alias("post_state"),
        (empty if errors is None else errors).alias("errors"),
    )
