"""URL filters by a Bloom filter cascade: exact membership without joins, DataFrame functions only.

Keys are `host/path-prefix` strings. The universe is every key that a url of the corpus could match; it is
made once, distinct, by a partially aggregated group (a hot host is one row a task). Level 1 of a cascade is a
Bloom filter of the listed keys; level 2 holds the unlisted keys of the universe that pass level 1; level 3 the
listed keys that pass level 2; and so on until no key is wrong. A key of the universe is listed when the first
level that it fails is an even one. A given list is joined with nothing but the few keys that pass level 1, to tell
those that are listed from the false ones. Filters are bit arrays of at most `most_bits` bits, which bounds what is
sent to the executors; a list that needs more is split by hash into parts of that size with a cascade each.

Rules: a rule `host/path` fits its host and all subdomains where the url's path starts with the rule's; the
longest wins. A url that no rule fits gets the method's verdict: block when its host, or a domain that it
belongs to, is on the block list, else allow. A url that is null or has no `://` has an empty host and path,
no rule, and is allowed. Repeated rows are judged each for itself; an empty table gives an empty result;
further columns than the key and url are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

BITS_PER_KEY, HASHES, MOST_BITS = 8, 4, 1 << 23
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed rules of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Names that, as a label of a host, put that domain on the block list.
BLOCKED_LABELS = ("cheap-pills", "casino-win", "spam-farm")


def host_and_path(urls: DataFrame) -> DataFrame:
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    known = F.coalesce(F.col("url").contains("://"), F.lit(False))
    return urls.withColumns({"host": F.when(known, host).otherwise(""), "path": F.when(known, path).otherwise("")})


def domains(host: Column) -> Column:
    """The host and all domains above it, longest first; none of an empty host."""
    labels = F.split(host, r"\.")
    at = F.when(host == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(labels)))
    return F.transform(at, lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule that could fit, for rule paths of these lengths, longest first."""
    keys = F.flatten(F.transform(domains(host), lambda d: F.filter(F.array(*(F.when(F.length(path) >= n, F.concat(d, F.substring(path, 1, n))) for n in lengths)), lambda k: k.isNotNull())))
    return F.reverse(F.array_sort(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key")))))


def bits(key: Column, level: int, size: int) -> list[Column]:
    """The bit numbers of a key in one level: double hashing."""
    a, b = (F.pmod(F.xxhash64(F.lit(2 * level + i), key), F.lit(size)) for i in range(2))
    return [(a + F.lit(i) * b) % F.lit(size) for i in range(HASHES)]


def passes(key: Column, words: Column, level: int, size: int) -> Column:
    """Whether all bits of a key are set; words: array of 64-bit words."""
    out = F.lit(True)
    for bit in bits(key, level, size):
        word = F.element_at(words, (F.floor(bit / 64) + 1).cast("int"))
        out = out & (F.call_function("bit_get", word, (bit % 64).cast("int")) == 1)
    return out


def filter_of(keys: DataFrame, level: int, size: int) -> DataFrame:
    """One row: the filter's words as an array; keys has `key`."""
    bit = keys.select(F.explode(F.array(*bits(F.col("key"), level, size))).alias("bit"))
    words = bit.groupBy((F.floor(F.col("bit") / 64)).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("word"))
    empty = keys.sparkSession.range(0, size // 64, 1, 1).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("word"))
    full = words.union(empty).groupBy("at").agg(F.max(F.struct(F.col("word") != 0, "word"))["word"].alias("word"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))


class Cascade:
    """Levels as (size, literal of the words); built on the driver from bounded bit arrays."""

    def __init__(self, listed: DataFrame, others: DataFrame, most_bits: int = MOST_BITS, known: DataFrame | None = None):
        """others: the unlisted keys of the universe; may still hold keys of the table `known`, which is part of listed."""
        self.parts: list[list[tuple[int, Column]]] = []
        n = listed.count()
        self.n_parts = max(1, math.ceil(n * BITS_PER_KEY / most_bits))
        for part in range(self.n_parts):
            mine = lambda frame: frame.filter(self.part_of(F.col("key")) == part) if self.n_parts > 1 else frame  # noqa: E731, B023
            self.parts.append(self.levels(mine(listed), mine(others), known))

    def part_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.n_parts))

    def levels(self, inside: DataFrame, outside: DataFrame, known: DataFrame | None = None) -> list[tuple[int, Column]]:
        out: list[tuple[int, Column]] = []
        while n := inside.count():
            level, size = len(out), max(64, 64 * math.ceil(n * BITS_PER_KEY / 64))
            words = filter_of(inside, level, size).first()["words"]  # at most most_bits bits
            held = F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<bigint>")
            out.append((size, held))
            passed = outside.filter(passes(F.col("key"), held, level, size))
            if level == 0 and known is not None:  # of the universe only what passes the first level is told apart by the list itself
                passed = S.materialise(passed.join(known, "key", "left_anti"))
            inside, outside = passed, inside
        return out

    def holds(self, key: Column) -> Column:
        """Membership of a key of the universe."""
        found = F.lit(False)
        for part, levels in enumerate(self.parts):
            inside = F.lit(len(levels) % 2 == 1)
            for level in range(len(levels) - 1, -1, -1):
                size, words = levels[level]
                inside = F.when(passes(key, words, level, size), inside).otherwise(F.lit(level % 2 == 1))
            found = found | (inside if self.n_parts == 1 else (self.part_of(key) == part) & inside)
        return found


def url_filter(urls: DataFrame, rules: dict[str, str], listed: DataFrame | None = None, blocked_labels: tuple[str, ...] = (), most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule and verdict of each url.

    listed: a table of blocked domains (domain string); blocked_labels: domains whose first label is one of
    these are listed, too.
    """
    spark = urls.sparkSession
    rows = host_and_path(urls.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")))
    lengths = sorted({len(r) - r.index("/") for r in rules}) or [1]
    names = list(rules) or [""]

    rule_universe = S.materialise(rows.select(F.explode(rule_keys(F.col("host"), F.col("path"), lengths)).alias("k")).select("k.key").distinct())
    ruled = spark.createDataFrame([(r, v == "allow") for r, v in rules.items()], "key string, allow boolean")
    fits = Cascade(ruled.select("key"), rule_universe.filter(~F.col("key").isin(names)), most_bits)
    allows = Cascade(ruled.filter("allow").select("key"), ruled.filter("not allow").select("key"), most_bits)

    by_label = F.coalesce(F.substring_index("key", ".", 1).isin(list(blocked_labels)) if blocked_labels else F.lit(False), F.lit(False))
    host_universe = S.materialise(rows.select(F.explode(domains(F.col("host"))).alias("key")).distinct().withColumn("listed", by_label))
    named, others = host_universe.filter("listed").select("key"), host_universe.filter("not listed").select("key")
    known = listed.select(F.translate("domain", UPPER, LOWER).alias("key")).filter("key is not null").distinct() if listed is not None else None
    blocked = Cascade(named if known is None else named.unionByName(known).distinct(), others, most_bits, known)

    rule = F.filter(rule_keys(F.col("host"), F.col("path"), lengths), lambda k: fits.holds(k["key"]))
    rule = F.when(F.size(rule) > 0, F.element_at(rule, 1)["key"])
    out = rows.withColumn("rule", rule)
    by_list = F.when(F.exists(domains(F.col("host")), blocked.holds), "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNull(), by_list).when(allows.holds(F.col("rule")), "allow").otherwise("block")
    return out.withColumn("verdict", verdict).select("page_id", "host", "path", "rule", "verdict")


def op3_sql(rules: dict[str, str] = RULES, labels: tuple[str, ...] = BLOCKED_LABELS) -> str:
    """The same in DuckDB SQL."""
    cases = []
    for r in sorted(rules, key=lambda r: (-len(r), r)):
        host, path = r[: r.index("/")], r[r.index("/") :]
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{r}'")
    allowed = ", ".join(f"'{r}'" for r, v in rules.items() if v == "allow")
    bad = " OR ".join(f"list_contains(string_split(host, '.'), '{x}')" for x in labels) or "false"
    return f"""
WITH a AS (SELECT page_id, url, contains(url, '://') AS known, substr(url, instr(url, '://') + 3) AS rest FROM pages),
b AS (SELECT page_id, CASE WHEN known THEN translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END AS host,
 CASE WHEN known THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM a),
c AS (SELECT *, CASE {' '.join(cases)} END AS rule FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({allowed}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict FROM c"""
