"""Heavy steps run in many tasks, whatever the size of what they read."""

from pyspark.sql import functions as F

from strataloom.operators import code as C
from strataloom.operators import graph as G


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_edges_with_many_cycles_are_walked_in_several_tasks(spark):
    edges = spark.range(64).select((2 * F.col("id")).alias("src"), (2 * F.col("id") + 1).alias("dst"))
    both = edges.union(edges.select("dst", "src"))
    got = G.cycles(both).select("cycle", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.cycle for r in got) == [[2 * i, 2 * i + 1] for i in range(64)]
    assert len({r.task for r in got}) > 4


def test_words_of_exports_are_cut_in_dealt_rows(spark):
    files = spark.createDataFrame([("a.ts", "export const one = 1"), ("b.ts", "export const two = one")], "path string, text string").coalesce(1)
    out = C.unused_exports(files)
    assert plan_of(out).count("Repartition 8, true") == 2
    assert [tuple(r) for r in out.collect()] == [("b.ts", "two")]
