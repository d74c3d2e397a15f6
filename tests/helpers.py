"""Small frames for tests."""

from datetime import date, timedelta

from pyspark.sql import functions as F


def daily(spark, series, start=date(2023, 1, 1), schema="series string, date date, value double"):
    """series: {name: values}; consecutive days."""
    rows = [(g, start + timedelta(days=i), None if v is None else float(v)) for g, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, schema)


def single(spark, values, start=date(2023, 1, 1)):
    rows = [(start + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, value double")


def column(df, name, order="date", where=None):
    df = df.where(where) if where is not None else df
    return [r[0] for r in df.orderBy(order).select(F.col(name)).collect()]
