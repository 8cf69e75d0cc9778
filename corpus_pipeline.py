"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage judges each row for itself or by a key that it gives the row, so doc_id may be null or shared by rows:
nothing is lost or multiplied. Null and empty texts: the classifier scores them like other texts without words;
near-dedup keeps one row of equal (doc_id, text); suffix dedup and decontamination pass them on; packing makes one
end token. Repeated rows lose all but one in near-dedup; ties go to the smallest doc_id, then to any one row. Very
long texts are worked on whole. An empty table gives an empty result with the stage's columns, and columns beyond
those of documents are dropped by the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import decontam, minhash, packing, quality_bt, suffix_dedup
from strataloom.llm.queries import tokenizer_path
from strataloom.llm.shared import materialise, own_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    docs = docs.select(*COLUMNS)
    model = quality_bt.fit(docs, table(spark, sf_dir, "labels"))
    return quality_bt.score(docs, model).filter("predicted = 1").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row, written down so that it holds: doc_id can be null or shared."""
    return materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def by_row(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("row").alias("doc_id"), "text", *more)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id (a null one last); texts without words only go if doc_id and text are equal.

    Near copies have 0.8 or more of their five-word shingles in common.
    """
    docs = keyed(docs)
    found = minhash.near_dedup(by_row(docs)).select(F.col("doc_id").alias("row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"))
    alone = F.when(F.col("component").isNull(), F.struct("doc_id", "hash"))
    groups = found.join(docs.select("row", "doc_id", F.xxhash64("text").alias("hash")), "row").groupBy("component", alone.alias("alone"))
    first = groups.agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")).select("first.row")
    return docs.join(first, "row", "left_semi").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur at other places too."""
    rest = suffix_dedup.suffix_dedup(docs.select(*COLUMNS), with_text=True, carry=["lang", "source"])
    return rest.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark has not leaked into."""
    found = decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    return found.filter("not contaminated").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of binary lengths."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier), ("minhash_near_dedup", minhash_near_dedup), ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination), ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{own_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Training, suffix sorting and tokenizing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
