"""Benchmark statistics: intervals, effect sizes, corrections, variance components, cost and dominance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054  # fixed: the normal quantile at 0.975


# Coefficients of Acklam's rational approximation of the normal quantile, in the middle and in the tails.
MIDDLE_UP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_DOWN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_UP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_DOWN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """The highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The z below which a share p of the normal distribution lies; null where p is not between 0 and 1."""
    p = p.cast("double")
    near = F.least(p, 1 - p)  # the two tails mirror each other
    q, m = F.sqrt(-2 * F.log(near)), p - 0.5
    tail = polynomial(q, TAIL_UP) / polynomial(q, TAIL_DOWN)
    middle = polynomial(m * m, MIDDLE_UP) * m / polynomial(m * m, MIDDLE_DOWN)
    return F.when((p > 0) & (p < 1), F.when(near >= TAIL, middle).when(p < 0.5, tail).otherwise(-tail))


def wilson_at(successes: Column, trials: Column, confidence: Column) -> tuple[Column, Column]:
    """wilson() at any confidence, one for each row."""
    return wilson(successes, trials, normal_quantile((1 + confidence) / 2))


def wilson(successes: Column, trials: Column, z: float | Column = Z95) -> tuple[Column, Column]:
    """Score interval of a share; (0, 1) of no trials."""
    n = trials.cast("double")
    p = successes / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = (z / denominator) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(trials > 0, low).otherwise(0.0), F.when(trials > 0, high).otherwise(1.0)


def erf(x: Column) -> Column:
    """The error function of a number that is not negative, by its series of positive terms; exact to rounding."""
    z = F.least(x.cast("double"), F.lit(6.0))  # beyond, 1 to a double's precision
    start = F.struct(z.alias("term"), z.alias("total"))
    step = lambda acc, n: F.struct((acc["term"] * 2 * z * z / (2 * n + 1)).alias("term"), (acc["total"] + acc["term"] * 2 * z * z / (2 * n + 1)).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, step, lambda acc: acc["total"])
    return F.least(F.lit(1.0), F.lit(2 / math.sqrt(math.pi)) * F.exp(-z * z) * total)


def normal_cdf(x: Column) -> Column:
    """Phi."""
    half = erf(F.abs(x) / F.lit(math.sqrt(2.0))) / 2
    return F.when(x >= 0, 0.5 + half).otherwise(0.5 - half)


def moments(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def pairwise(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Welch's t with normal p, and Cohen's d, of each pair of groups; the pairs are of aggregated rows."""
    m = moments(rows, group, value)
    a, b = (m.select(*(F.col(c).alias(f"{c}_{s}") for c in m.columns)) for s in "ab")
    p = a.join(b, F.col("g_a") < F.col("g_b"))
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    gap = F.col("mean_a") - F.col("mean_b")
    t = F.when(enough, F.when(va + vb > 0, gap / F.sqrt(va + vb)).when(gap == 0, 0.0).otherwise(F.lit(float("inf"))))
    df = F.when(enough & (va + vb > 0), (va + vb) ** 2 / (va**2 / (F.col("n_a") - 1) + vb**2 / (F.col("n_b") - 1))).otherwise(0.0)
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    d = F.when(enough, F.when(pooled > 0, gap / pooled).when(gap == 0, 0.0).otherwise(F.lit(float("inf"))))
    out = p.select(F.concat_ws(" vs ", "g_a", "g_b").alias("pair"), t.alias("t"), df.alias("df"), d.alias("d"))
    return out.withColumn("p", F.when(F.abs("t") == F.lit(float("inf")), 0.0).otherwise(2 * (1 - normal_cdf(F.abs("t")))))


def holm(rows: DataFrame, label: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down corrected p values; one row a comparison, so the one window is small by nature."""
    w = Window.orderBy(p, label)
    everything = Window.partitionBy(F.lit(1))
    step = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(everything) - F.row_number().over(w) + 1))
    out = rows.withColumn("_step", step)
    out = out.withColumn("adjusted_p", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
    return out.withColumn("rejected", F.col("adjusted_p") < alpha)


def variance_components(rows: DataFrame, compressor: str = "compressor", fixture: str = "fixture", value: str = "b") -> DataFrame:
    """Method of moments for a balanced two-way design: one row."""
    sums = [F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.var_samp(value).alias("v")]
    cells = rows.groupBy(compressor, fixture).agg(*sums)
    grand = cells.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), (F.sum("q") / F.sum("n") - (F.sum("s") / F.sum("n")) ** 2).alias("total"), F.min("n").alias("runs"), F.sum(F.coalesce(F.col("v") * (F.col("n") - 1), F.lit(0.0))).alias("ss_res"), F.sum(F.greatest(F.lit(0), F.col("n") - 1)).alias("df_res"))
    level = lambda k, p: cells.groupBy(k).agg((F.sum("s") / F.sum("n")).alias("m")).agg(F.count("*").alias(f"n_{p}"), (F.var_samp("m")).alias(f"v_{p}"))
    one = grand.crossJoin(level(compressor, "c")).crossJoin(level(fixture, "f"))  # single rows
    res = F.when(F.col("df_res") > 0, F.col("ss_res") / F.col("df_res")).otherwise(0.0)
    ms_c = F.coalesce(F.col("v_c"), F.lit(0.0)) * F.col("n_f") * F.col("runs")
    ms_f = F.coalesce(F.col("v_f"), F.lit(0.0)) * F.col("n_c") * F.col("runs")
    out = one.select("mean", "total", F.col("n_c").alias("compressors"), F.col("n_f").alias("fixtures"), F.greatest(F.lit(0.0), (ms_c - res) / (F.col("n_f") * F.col("runs"))).alias("between_compressor"), F.greatest(F.lit(0.0), (ms_f - res) / (F.col("n_c") * F.col("runs"))).alias("between_fixture"), res.alias("residual"))
    pct = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    return out.withColumns({"pct_compressor": pct("between_compressor"), "pct_fixture": pct("between_fixture"), "pct_residual": pct("residual")})


def cost_factor(b: Column, n: Column, stable: Column, rho: float = 0.10) -> Column:
    """Relative cost of n uses with byte saving b, where a stable prefix is read again at rho."""
    return (1 - b) * (1 + (n - 1) * (stable * rho + 1 - stable))


def pareto(rows: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """Rows that no other beats on every axis; equal rows both stay, and a row with a missing value is never beaten.

    Each task first keeps what none of its own rows beats, so that only these few meet each other.
    """

    def front(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for frame in frames:
            both = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            x = both[axes].to_numpy(float)
            order = np.argsort(-np.nan_to_num(x, nan=np.inf).sum(1), kind="stable")
            held = np.empty((0, len(axes)))
            stays = np.zeros(len(both), bool)
            for i in order:  # a row can only be beaten by one with a larger sum
                if not ((held >= x[i]).all(1) & (held > x[i]).any(1)).any():
                    stays[i] = True
                    held = np.vstack([held, x[i]])
            kept = both[stays]
        if kept is not None:
            yield kept

    few = rows.mapInPandas(front, rows.schema)
    other = rows.select(*axes).mapInPandas(front, rows.select(*axes).schema).select(*(F.col(a).alias(f"o_{a}") for a in axes)).distinct()
    no_worse, better = F.lit(True), F.lit(False)
    for a in axes:
        no_worse, better = no_worse & (F.col(f"o_{a}") >= F.col(a)), better | (F.col(f"o_{a}") > F.col(a))
    return few.join(other, no_worse & better, "left_anti")


#: Fixed: the chances of at most 0, 1, 2 ... draws of a Poisson variable with mean 1.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring numbers give unrelated ones."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def resampled(resamples: int):
    """Rows (g, n, s, h): of each group the weighted sums of every resample over this task's clusters."""
    each = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = max(1, (1 << 21) // resamples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}

        def handed_on() -> pa.RecordBatch:
            names, values = list(sums), [x for pair in sums.values() for x in pair]
            lists = [pa.array(values[k::2], pa.list_(pa.float64())) for k in (0, 1)]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *lists], names=["g", "s", "n"])

        for batch in batches:
            g, n, s, h = (batch.column(c) for c in range(4))
            codes = g.dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.fill_null(-1).to_numpy()
            facts = np.stack([s.fill_null(0).to_numpy(), n.to_numpy()]).astype(float)
            keys = h.to_numpy().view(np.uint64)
            for k in np.unique(code):
                own = np.flatnonzero(code == k)
                name = names[k] if k >= 0 else None
                total = sums.setdefault(name, np.zeros((2, resamples)))
                for i in range(0, len(own), rows):
                    part = own[i : i + rows]
                    u = (mixed(keys[part][:, None] + each[None, :]) >> np.uint64(12)).astype(float) / 2.0**52
                    total += facts[:, part] @ np.searchsorted(POISSON, u.ravel(), "right").reshape(u.shape).astype(float)
                if len(sums) * resamples > 1 << 22:
                    yield handed_on()
        if sums:
            yield handed_on()

    return run


def bootstrap(rows: DataFrame, group: str, cluster: str, value: str, resamples: int = 2000, seed: int = 42, conf: float = 0.95) -> DataFrame:
    """Cluster bootstrap interval of the mean: g, clusters, point, low, high.

    Every cluster gets a Poisson weight of mean 1 in each resample, drawn by a hash of seed, cluster and resample. A task
    keeps the weighted sums of its clusters, `resamples` numbers a group, so clusters are never multiplied and a group of
    any number of them is spread over all tasks. Weights are reproducible, but not those of drawing with replacement
    by a seeded generator.
    """
    small = rows.groupBy(F.col(group).cast("string").alias("g"), F.col(cluster).cast("string").alias("c")).agg(F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("s"))
    drawn = small.select("g", "n", "s", F.xxhash64(F.lit(seed), "c").alias("h")).mapInArrow(resampled(resamples), "g string, s array<double>, n array<double>")
    drawn = drawn.select("g", F.posexplode(F.arrays_zip("s", "n")).alias("r", "x")).groupBy("g", "r").agg(F.sum("x.s").alias("s"), F.sum("x.n").alias("n")).filter("n > 0")
    draws = drawn.groupBy("g").agg(F.sort_array(F.collect_list(F.col("s") / F.col("n"))).alias("d"))  # `resamples` numbers a group
    point = small.groupBy("g").agg(F.count("*").alias("clusters"), (F.sum("s") / F.sum("n")).alias("point"))
    alpha = (1 - conf) / 2
    at = lambda i: F.element_at("d", i.cast("int"))
    n = F.size("d")
    return point.join(draws, "g", "left").select("g", "clusters", "point", at(F.floor(alpha * n) + 1).alias("low"), at(F.greatest(F.lit(1), F.floor((1 - alpha) * n))).alias("high"))
