"""Getting this package to the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once a session; they need not have it installed.

    Spark's own file server hands the archive out, so the driver's folder need not be shared.
    """
    sc = spark.sparkContext
    if getattr(sc, "_strataloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "strataloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("strataloom", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._strataloom_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """df, with its rows dealt out to all cores if its scan may have fewer tasks with rows than the cluster has cores.

    For heavy work on each row: a small table is often one row group, which only one task reads, into however many
    splits its file is cut. From four splits a core on, splits are as large as row groups, and a table is left as it
    is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= 4 * cores else df.repartition(2 * cores)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder: that in spark.checkpoint.dir; where it is unset and Spark runs on one machine, a new local one."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/strataloom-{sc.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage in loops and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
