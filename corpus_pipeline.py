"""A training-data pipeline of five stages, each one of the operators in ``seriesmill.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return
the columns of ``documents``; the last returns the mix, each document as often as
it is drawn. Each stage handles null and empty texts, repeated rows and ids, empty
tables and further columns as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import decontamination, jaccard_join, mixing, quality_rules, substring_dedup
from seriesmill.llm.common import Tables, row_id


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality_rules.with_policy(quality_rules.ledger(docs)).where("kept").select("__row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; documents without words are no copies."""
    uid = row_id(docs)
    if uid is None:  # not read from files: number the rows once
        docs = Tables(spark, "docs").save(docs, "rows")
        uid = row_id(docs)
    first = jaccard_join.near_copies(docs).where("first").select(F.col("uid").alias("__uid"))
    first = Tables(spark, "first").save(first, "rows")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), uid.alias("__uid"))
    return rows.join(first, "__uid", "left_semi").select("__row.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur again are cut from the texts."""
    return substring_dedup.remove(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights, one row per copy."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", rules),
    ("jaccard_join", near_copies),
    ("substring_dedup", substrings),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: No stage but the first and the last can be said in SQL over whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
