"""Rolling-origin cross-validation and accuracy."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .forecasting import fit
from .panel import TimeSeriesFrame

METRICS = ("rmse", "mae", "mse", "mape")
LEAST_TRAIN = 10


def metric(name: str, actual: Column, predicted: Column) -> Column:
    """An accuracy aggregate; mape is in percent over rows whose actual is not zero."""
    e = actual - predicted
    return {
        "rmse": lambda: F.sqrt(F.avg(e * e)),
        "mse": lambda: F.avg(e * e),
        "mae": lambda: F.avg(F.abs(e)),
        "mape": lambda: 100 * F.avg(F.abs(e / F.nullif(actual, F.lit(0.0)))),
    }[name]()


@dataclass(frozen=True)
class Fold:
    """Places (from 1) of a fold's first and last dates among all dates."""

    fold: int
    train_start: int
    train_end: int
    test_start: int
    test_end: int


def folds(n: int, h: int, n_windows: int, window_type: str = "expanding", window_size: int | None = None, step_size: int | None = None) -> list[Fold]:
    """Test windows of h dates; the first ends h * (n_windows - 1) dates before the last date, whatever the step."""
    for name, v in (("h", h), ("n_windows", n_windows), ("step_size", step_size), ("window_size", window_size)):
        if v is not None and (isinstance(v, bool) or int(v) != v or v < 1):
            raise ValueError(f"{name} must be a whole number of 1 or more")
    if window_type not in ("expanding", "sliding"):
        raise ValueError("window_type is expanding or sliding")
    if window_type == "sliding" and window_size is None:
        raise ValueError("a sliding window needs window_size")
    least = window_size if window_type == "sliding" else LEAST_TRAIN
    out: list[Fold] = []
    for end in list(range(n - h * (n_windows - 1), n + 1, step_size or h))[-n_windows:]:
        start = end - h + 1
        if start < 1:
            continue
        first = 1 if window_type == "expanding" else max(1, start - window_size)
        if start - first < least:
            continue
        out.append(Fold(len(out) + 1, first, start - 1, start, end))
    return out


def alignment(df: DataFrame, date: str, groups: Sequence[str]) -> DataFrame:
    """One row: series, and how many different lists of dates they have."""
    per = df.groupBy(*groups).agg(F.xxhash64(F.array_sort(F.collect_set(date))).alias("dates"))
    return per.agg(F.count("*").alias("n_series"), F.count_distinct("dates").alias("n_date_lists"))


def dated(df: DataFrame, date: str) -> DataFrame:
    """Adds ``place``, the rank of the date among all dates; the ranks come from the distinct dates, not the rows."""
    places = df.select(date).distinct().withColumn("place", F.row_number().over(Window.orderBy(date)))
    return df.join(places, date)


@dataclass
class CVResult:
    metrics: DataFrame
    params: dict
    predictions: DataFrame | None = None

    def summary(self) -> DataFrame:
        """Mean, median, deviation, least and largest of the folds' metric, without the overall row."""
        m = self.params["metric"]
        return self.metrics.where("fold > 0").agg(F.avg(m).alias("mean"), F.median(m).alias("median"), F.stddev_samp(m).alias("sd"), F.min(m).alias("min"), F.max(m).alias("max"))

    def __repr__(self) -> str:
        return f"CVResult({', '.join(f'{k}={v}' for k, v in self.params.items())})"


def fold_metrics(predictions: DataFrame, name: str) -> DataFrame:
    """(fold, metric, n_test) from predictions(fold, actual, predicted), with fold 0 over all: weighted by n_test, rmse through its squares."""
    per = predictions.groupBy("fold").agg(metric(name, F.col("actual"), F.col("predicted")).alias(name), F.count("*").alias("n_test"))
    return per.unionByName(overall(per, name))


def overall(per: DataFrame, name: str) -> DataFrame:
    v = F.col(name) * F.col(name) if name == "rmse" else F.col(name)
    known = F.when(F.col(name).isNotNull(), F.col("n_test"))
    mean = F.sum(v * known) / F.sum(known)
    return per.agg((F.sqrt(mean) if name == "rmse" else mean).alias(name), F.sum("n_test").alias("n_test")).select(F.lit(0).alias("fold"), name, "n_test")


def cv_forecast(
    formula: str, data: DataFrame | TimeSeriesFrame, model=None, *, date: str | None = None, groups: Sequence[str] | None = None, frequency=None, h: int = 1, n_windows: int = 5,
    window_type: str = "expanding", window_size: int | None = None, step_size: int | None = None, metric: str | Callable = "rmse", return_predictions: bool = False,
) -> CVResult:
    """Refits on each fold's training dates, forecasts its test dates (with their exogenous values) and compares."""
    if isinstance(data, TimeSeriesFrame):
        date, groups, frequency, df = date or data.date, data.groups if groups is None else groups, frequency or data.frequency, data.df
    else:
        df = data
    groups = list(groups or [])
    if not callable(metric) and metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)} or a function")
    if groups:
        row = alignment(df, date, groups).first()
        if row["n_date_lists"] > 1:
            raise ValueError("all series need identical date sequences for cross-validation")
    # every fold reads the panel: kept on the executors until the folds are done
    placed = dated(df, date).persist()
    try:
        return _cross_validated(formula, placed, model, date, groups, frequency, h, n_windows, window_type, window_size, step_size, metric, return_predictions)
    finally:
        placed.unpersist()


def _cross_validated(formula, placed, model, date, groups, frequency, h, n_windows, window_type, window_size, step_size, metric, return_predictions) -> CVResult:
    n = placed.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    plan = folds(n, h, n_windows, window_type, window_size, step_size)
    if not plan:
        raise ValueError(f"{n} dates are too few for these folds")
    parts = []
    for f in plan:
        train = placed.where(F.col("place").between(f.train_start, f.train_end)).drop("place")
        test = placed.where(F.col("place").between(f.test_start, f.test_end)).drop("place")
        try:
            fitted = fit(formula, train, model, date=date, groups=groups, frequency=frequency)
            y = fitted.spec.target
            future = test.select(*dict.fromkeys([*groups, date, *fitted.spec.exogenous]))
            found = fitted.forecast(future=future)
            right = test.select(*[F.col(c).alias(f"__t_{c}") for c in [*groups, date]], F.col(y).cast("double").alias("actual"))
            cond = F.col(date) == F.col(f"__t_{date}")
            for c in groups:
                cond = cond & F.col(c).eqNullSafe(F.col(f"__t_{c}"))
            part = found.join(right, cond).select(F.lit(f.fold).alias("fold"), *groups, date, "actual", F.col(f"{y}_forecast").alias("predicted"))
            part = part.persist()
            zeros = part.agg(F.count_if(F.col("actual") == 0)).first()[0]  # runs the fold, so that what fails in a task counts too
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"fold {f.fold} is left out: {e}", stacklevel=3)
            continue
        if metric == "mape" and zeros:
            warnings.warn(f"mape: {zeros} actual values of zero in fold {f.fold} do not count", stacklevel=3)
        parts.append(part)
    if not parts:
        raise ValueError("every fold failed")
    predictions = parts[0]
    for p in parts[1:]:
        predictions = predictions.unionByName(p)
    if callable(metric):
        name, fn = "metric", metric

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            v = fn(pdf["actual"].to_numpy(), pdf["predicted"].to_numpy())
            if np.ndim(v) != 0:
                raise ValueError("a metric function returns one number")
            return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "metric": [float(v)], "n_test": [len(pdf)]})

        per = predictions.select("fold", "actual", "predicted").groupBy("fold").applyInPandas(run, "fold int, metric double, n_test long")
        metrics = per.unionByName(overall(per, "metric"))
    else:
        name, metrics = metric, fold_metrics(predictions, metric)
    params = {"h": h, "n_windows": n_windows, "window_type": window_type, "window_size": window_size, "step_size": step_size or h, "metric": name}
    return CVResult(metrics, params, predictions if return_predictions else None)


def accuracy_by_step(predictions: DataFrame, date: str, groups: Sequence[str] = (), name: str = "rmse") -> DataFrame:
    """The metric at each distance from the origin."""
    w = Window.partitionBy("fold", *groups).orderBy(date)
    return predictions.withColumn("step", F.row_number().over(w)).groupBy("step").agg(metric(name, F.col("actual"), F.col("predicted")).alias(name))


def accuracy_by_group(predictions: DataFrame, groups: Sequence[str], name: str = "rmse") -> DataFrame:
    return predictions.groupBy(*groups).agg(metric(name, F.col("actual"), F.col("predicted")).alias(name))


def compare_models(formula: str, data, models: dict[str, object], **kw) -> DataFrame:
    """(model, metric, n_test): the overall row of each model's cross-validation."""
    out = None
    for name, m in models.items():
        row = cv_forecast(formula, data, m, **kw).metrics.where("fold = 0").select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out.drop("fold")


def grid_search(formulas: Sequence[str], data, model=None, **kw) -> DataFrame:
    """(formula, metric, n_test) of each formula, over one cached panel."""
    frame = data.df if isinstance(data, TimeSeriesFrame) else data
    frame.cache()
    try:
        rows = []
        for formula in formulas:
            rows.append((formula, *cv_forecast(formula, data, model, **kw).metrics.where("fold = 0").drop("fold").first()))
    finally:
        frame.unpersist()
    name = kw.get("metric", "rmse")
    return frame.sparkSession.createDataFrame(rows, f"formula string, {name if isinstance(name, str) else 'metric'} double, n_test long")
