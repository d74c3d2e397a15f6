"""Canonical panels over the test tables, and a generated monthly retail panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 (series, date, y, x): shipped quantity and lines per return flag and day."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series"), F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    return t.groupBy("series", "date").agg(F.sum("l_quantity").alias("y"), F.count("*").alias("x"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 (series, date, y): order value per priority and month."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("date"), "o_totalprice")
    return t.groupBy("series", "date").agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 (series, date, y): event value per type and hour."""
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date"), "value")
    return t.groupBy("series", "date").agg(F.round(F.sum("value"), 2).alias("y"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 (series, date, y): event value per user and day."""
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("ts").cast("date").alias("date"), "value")
    return t.groupBy("series", "date").agg(F.round(F.sum("value"), 2).alias("y"))


def masked(panel: DataFrame, every: int = 11) -> DataFrame:
    """Nulls in place of y on every so manieth day since 1995-01-01."""
    days = F.call_function("datediff", F.col("date").cast("date"), F.lit("1995-01-01").cast("date"))
    return panel.withColumn("y", F.when(F.pmod(days, F.lit(every)) != 0, F.col("y")))


def retail(spark: SparkSession, items: int = 42, months: int = 333) -> DataFrame:
    """(items, date, value): a generated monthly panel with level, trend, season and noise that depends only on item and month."""
    t = spark.range(items * months).select((F.col("id") % items).cast("int").alias("i"), F.floor(F.col("id") / items).cast("int").alias("m"))
    noise = F.pmod(F.xxhash64("i", "m"), F.lit(1000)) / 1000.0 - 0.5
    date = F.add_months(F.lit("1997-04-01").cast("date"), F.col("m"))
    value = 100 + 5 * F.col("i") + 0.3 * F.col("m") + 20 * F.sin(2 * F.pi() * F.month(date) / 12) + 10 * noise
    return t.select(F.format_string("item%02d", "i").alias("items"), date.alias("date"), F.round(value, 4).alias("value"))
