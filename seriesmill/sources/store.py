"""Tables in and out, and fitted models kept beside the history they forecast from."""

from __future__ import annotations

import json
import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forecasting import Fit

FORMATS = ("parquet", "orc", "csv", "json")


def read_panel(spark: SparkSession, path: str, date: str, kind: str = "parquet", timestamp: bool = False, **options) -> DataFrame:
    """A table with its date column as a date, or as a timestamp without zone."""
    if kind not in FORMATS:
        raise ValueError(f"kind is one of {', '.join(FORMATS)}")
    if kind == "csv":
        options = {"header": True, "inferSchema": True} | options
    df = spark.read.options(**options).format(kind).load(path)
    return df.withColumn(date, F.col(date).cast("timestamp_ntz" if timestamp else "date"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options) -> None:
    if kind not in FORMATS:
        raise ValueError(f"kind is one of {', '.join(FORMATS)}")
    df.write.mode(mode).options(**({"header": True} if kind == "csv" else {}) | options).format(kind).save(path)


def save_fit(f: Fit, path: str) -> None:
    """History as Parquet, the model and its settings as one pickled row; works on any file system Spark writes to."""
    spark = f.history.sparkSession
    f.history.write.parquet(f"{path}/history")
    held = pickle.dumps({"model": f.model, "spec": f.spec, "formula": f.formula, "date": f.date, "groups": f.groups, "frequency": f.frequency, "predictors": f.predictors})
    about = json.dumps({"formula": f.formula, "model": type(f.model).__name__})
    spark.createDataFrame([(about, bytearray(held))], "about string, fit binary").coalesce(1).write.parquet(f"{path}/fit")


def load_fit(spark: SparkSession, path: str) -> Fit:
    """The counterpart of save_fit. Only load what you saved yourself: unpickling runs code."""
    return Fit(history=spark.read.parquet(f"{path}/history"), **pickle.loads(bytes(spark.read.parquet(f"{path}/fit").first()["fit"])))
