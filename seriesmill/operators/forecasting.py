"""Fit and recursive forecast.

``fit`` builds the features, drops incomplete rows and fits one model over all
series. A forecast goes one of three ways:

* batch: no feature of the target, so the h rows are one projection;
* fold: a linear model, where each series is a row holding its last values, and
  the h steps are one higher-order ``aggregate`` over them, inside the JVM;
* pandas: any other model, one ``applyInPandas`` per series.

All three bind features by name and give the same results.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeaxis import Frequency, is_time_type
from ..plans.formula import FeatureSpec, Term, parse
from .features import apply_terms, build_features, calendar, cleaned, ordered, trend_value
from .models import OLS, LinearFit, Predictor, capture_schema, harmonise, warn_unseen
from .panel import TimeSeriesFrame, future_dates, median_step_dates

XREG = ("carry", "zeros", "NA", "error")


@dataclass
class Fit:
    model: Any
    spec: FeatureSpec
    formula: str
    history: DataFrame
    date: str
    groups: list[str]
    frequency: Frequency | None
    predictors: list[Predictor]
    n_train: int | None = None
    notes: dict = field(default_factory=dict)

    def forecast(self, h: int | None = None, future: DataFrame | None = None, xreg_strategy: str = "carry", return_index: bool = False, engine: str = "auto", on_error: str = "raise") -> DataFrame:
        return forecast(self, h, future, xreg_strategy, return_index, engine, on_error)

    def __repr__(self) -> str:
        return f"Fit({self.formula}; {type(self.model).__name__}; groups: {', '.join(self.groups) or '-'})"


def train_matrix(df: DataFrame, formula: str | FeatureSpec, date: str, groups: Sequence[str] = (), window_lag: int = 0) -> DataFrame:
    """(groups, date, target, features): the complete rows a model is fitted on."""
    spec = parse(formula, df.columns) if isinstance(formula, str) else formula
    out = build_features(cleaned(df, [spec.target]), spec, date, groups, window_lag).select(*dict.fromkeys([*groups, date, spec.target, *spec.columns]))
    return cleaned(out, spec.columns).dropna(subset=[spec.target, *spec.columns])


def fit(formula: str, data: DataFrame | TimeSeriesFrame, model: Any = None, *, date: str | None = None, groups: Sequence[str] | None = None, frequency=None, window_lag: int = 0) -> Fit:
    """One pooled model; group columns are no predictors. ``data`` may be a TimeSeriesFrame, which brings date, groups and frequency."""
    if isinstance(data, TimeSeriesFrame):
        date, groups, frequency, df = date or data.date, data.groups if groups is None else groups, frequency or data.frequency, data.df
    else:
        df = data
    if date is None or date not in df.columns:
        raise ValueError(f"{date!r} is not a column; give date=")
    if not is_time_type(df.schema[date].dataType):
        raise TypeError(f"{date!r} must hold dates or timestamps")
    groups = list(groups or [])
    spec = parse(formula, df.columns)
    if window_lag not in (0, 1):
        raise ValueError("window_lag is 0 or 1")
    train = train_matrix(df, spec, date, groups, window_lag)
    predictors = capture_schema(train, spec.columns)
    fitted = (model or OLS()).fit_frame(train, spec.target, predictors)
    history = cleaned(df, [spec.target, *spec.exogenous]).select(*dict.fromkeys([*groups, date, spec.target, *spec.exogenous]))
    return Fit(fitted, spec, formula, history, date, groups, Frequency.of(frequency) if frequency is not None else None, predictors)


def _last(f: Fit) -> DataFrame:
    """(groups, date, __n, __tail): rows and last values of each series, oldest first."""
    need = max(1, f.spec.memory)
    w = (Window.partitionBy(*f.groups) if f.groups else Window.partitionBy(F.lit(0))).orderBy(F.col(f.date).desc())
    y = F.col(f.spec.target).cast("double")
    tail = f.history.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= need)
    tail = tail.groupBy(*f.groups).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(f.date).alias("d"), y.alias("y")))), lambda x: x["y"]).alias("__tail"))
    size = f.history.groupBy(*f.groups).agg(F.count("*").alias("__n"), F.max(f.date).alias(f.date))
    if not f.groups:
        return size.join(tail, F.lit(True))  # one row each
    right = tail.select(*[F.col(c).alias(f"__g_{c}") for c in f.groups], "__tail")
    return size.join(right, _same(f.groups, "__g_")).select(*f.groups, f.date, "__n", "__tail")


def _same(groups: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for c in groups:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return cond


def future_xreg(f: Fit, grid: DataFrame, future: DataFrame | None, strategy: str = "carry") -> DataFrame:
    """The grid with every exogenous column and feature: given values, or carried, zero, missing; lags and means look back over history and future together."""
    if strategy not in XREG:
        raise ValueError(f"xreg_strategy is one of {', '.join(XREG)}")
    keys = [*f.groups, f.date]
    xs = f.spec.exogenous
    given = [x for x in xs if future is not None and x in future.columns]
    absent = [x for x in xs if x not in given]
    if absent and strategy == "error":
        raise ValueError(f"no future values of {', '.join(absent)}")
    if given:
        right = cleaned(future, given).select(*[F.col(k).alias(f"__f_{k}") for k in keys], *given)
        grid = grid.join(right, _same(keys, "__f_"), "left").drop(*[f"__f_{k}" for k in keys])
    if absent and strategy == "carry":
        last = f.history.groupBy(*f.groups).agg(*[F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.col(f.date))).alias(x) for x in absent])
        _warn_carry(f, absent)
        if f.groups:
            right = last.select(*[F.col(c).alias(f"__f_{c}") for c in f.groups], *absent)
            grid = grid.join(right, _same(f.groups, "__f_"), "left").drop(*[f"__f_{c}" for c in f.groups])
        else:
            grid = grid.join(last, F.lit(True))  # one row
    elif absent:
        for x in absent:
            kind = f.history.schema[x].dataType
            if strategy == "zeros" and not isinstance(kind, T.NumericType):
                raise ValueError(f"{x!r} is {kind.simpleString()}; zeros stand only for numbers")
            grid = grid.withColumn(x, F.lit(0 if strategy == "zeros" else None).cast(kind))
    terms = f.spec.of("xlag", "xma")
    if not terms:
        return grid
    # only as many rows of history as the longest look back
    need = max(t.n for t in terms)
    w = (Window.partitionBy(*f.groups) if f.groups else Window.partitionBy(F.lit(0))).orderBy(F.col(f.date).desc())
    old = f.history.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= need).drop("__r", f.spec.target)
    both = old.withColumn("__new", F.lit(False)).unionByName(grid.withColumn("__new", F.lit(True)), allowMissingColumns=True)
    return apply_terms(both, terms, f.date, f.groups).where("__new").drop("__new")


def _warn_carry(f: Fit, columns: Sequence[str]) -> None:
    """One aggregation: which carried columns have no value at all in a series, or none in its last row."""
    per = f.history.groupBy(*f.groups).agg(*[F.count(x).alias(f"n_{x}") for x in columns], *[F.max_by(F.col(x).isNull(), f.date).alias(f"e_{x}") for x in columns])
    row = per.agg(*[F.count_if(F.col(f"n_{x}") == 0).alias(f"n_{x}") for x in columns], *[F.count_if((F.col(f"n_{x}") > 0) & F.col(f"e_{x}")).alias(f"e_{x}") for x in columns]).first()
    for x in columns:
        if row[f"n_{x}"]:
            warnings.warn(f"carry: {x!r} has no values in {row[f'n_{x}']} series; their forecasts have missing features", stacklevel=4)
        if row[f"e_{x}"]:
            warnings.warn(f"carry: {x!r} ends with a missing value in {row[f'e_{x}']} series; an earlier value is carried", stacklevel=4)


def _check_future(f: Fit, future: DataFrame, h: int | None) -> int:
    missing = [c for c in [*f.groups, f.date] if c not in future.columns]
    if missing:
        raise ValueError(f"future has no column {', '.join(missing)}")
    per = future.groupBy(*f.groups).agg(F.count("*").alias("n"), F.count_distinct(f.date).alias("d"))
    row = per.agg(F.min("n"), F.max("n"), F.max(F.col("n") - F.col("d"))).first()
    if not row[0]:
        raise ValueError("future has no rows")
    if row[2]:
        raise ValueError("future has a date twice in a series")
    if row[0] != row[1]:
        raise ValueError("future must have as many rows for each series")
    if h is not None and h != row[0]:
        raise ValueError(f"h is {h}, but future has {row[0]} rows a series")
    return int(row[0])


def forecast(f: Fit, h: int | None = None, future: DataFrame | None = None, xreg_strategy: str = "carry", return_index: bool = False, engine: str = "auto", on_error: str = "raise") -> DataFrame:
    """(groups, date or step, {target}_forecast), h rows a series.

    With ``future`` its dates are used; else dates follow from the frequency, or
    from the median step. engine: auto, native or pandas. return_index gives the
    step in place of the date.
    """
    if h is None and future is None:
        raise ValueError("give h or future")
    if h is not None and (isinstance(h, bool) or int(h) != h or h < 1):
        raise ValueError("h must be a whole number of 1 or more")
    if xreg_strategy not in XREG:
        raise ValueError(f"xreg_strategy is one of {', '.join(XREG)}")
    if engine not in ("auto", "native", "pandas"):
        raise ValueError("engine is auto, native or pandas")
    if f.spec.recursive:
        ends = f.history.groupBy(*f.groups).agg(F.max_by(F.col(f.spec.target).isNull(), f.date).alias("gone"), F.count("*").alias("n"))
        gone, least = ends.agg(F.count_if("gone"), F.min(F.when(F.col("n") > 0, F.col("n")))).first()
        if gone:
            raise ValueError(f"trailing NA: the last {f.spec.target!r} is missing in {gone} series")
        if least is not None and least < f.spec.memory:
            warnings.warn(f"the shortest series has {least} rows, the formula looks back {f.spec.memory}; its forecasts start missing", stacklevel=2)
    out = f"{f.spec.target}_forecast"
    last = _last(f)
    if future is not None:
        h = _check_future(f, future, h)
        grid = future.select(*f.groups, f.date)
        step = F.row_number().over(ordered(f.date, f.groups))
        grid = grid.withColumn("step", step)
    elif f.frequency is not None:
        grid = future_dates(last.select(*f.groups, f.date), f.date, h, f.frequency)
    else:
        grid = median_step_dates(f.history.select(*f.groups, f.date), f.date, f.groups, h)
    grid = future_xreg(f, grid, future, xreg_strategy)
    given = [p for p in f.predictors if p.name in grid.columns]
    warn_unseen(grid, given)
    grid = harmonise(grid, given, [c for c in grid.columns if c not in {p.name for p in given}])
    right = last.select(*[F.col(c).alias(f"__g_{c}") for c in f.groups], "__n", "__tail")
    grid = grid.join(right, _same(f.groups, "__g_")) if f.groups else grid.join(right, F.lit(True))
    kind = grid.schema[f.date].dataType
    for t in f.spec.of("cal"):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            grid = grid.withColumn(t.column, calendar(t.column, F.col(f.date), kind))
    for t in f.spec.of("trend"):
        grid = grid.withColumn(t.column, trend_value(F.col("__n") + F.col("step"), t.n))
    linear = isinstance(f.model, LinearFit)
    if engine == "native" and not linear:
        raise ValueError("only linear models have native forecasts")
    index = "step" if return_index else f.date
    if linear and engine != "pandas":
        done = _fold(f, grid, h) if f.spec.recursive else grid.withColumn("__y", f.model.expression())
    else:
        done = _stepwise(f, grid, on_error)
    return done.select(*f.groups, index, F.col("__y").alias(out))


def _window_value(kind: str, tail: Column, n: int) -> Column:
    """A rolling statistic of the last n values of an array; null if it is shorter."""
    part = F.filter(F.slice(tail, -n, n), lambda x: x.isNotNull())
    count = F.size(part)
    total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    if kind == "rollslope":
        at = F.filter(F.transform(F.slice(tail, -n, n), lambda x, i: F.when(x.isNotNull(), F.struct(i.cast("double").alias("i"), x.alias("y")))), lambda p: p.isNotNull())
        si = F.aggregate(at, F.lit(0.0), lambda a, p: a + p["i"]) / count
        sy = total / count
        top = F.aggregate(at, F.lit(0.0), lambda a, p: a + (p["i"] - si) * (p["y"] - sy))
        low = F.aggregate(at, F.lit(0.0), lambda a, p: a + (p["i"] - si) * (p["i"] - si))
        value = F.when((count >= 2) & (low > 0), top / low)
    elif kind == "rollsd":
        mean = total / count
        value = F.when(count >= 2, F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (count - 1)))
    else:
        value = {"ma": F.when(count > 0, total / count), "rollsum": F.when(count > 0, total), "rollmin": F.array_min(part), "rollmax": F.array_max(part)}[kind]
    return F.when(F.size(tail) >= n, value)


def target_feature(t: Term, tail: Column) -> Column:
    """The value of a target feature for the row after an array of history."""
    return F.when(F.size(tail) >= t.n, F.element_at(tail, -t.n)) if t.kind == "lag" else _window_value(t.kind, tail, t.n)


def _fold(f: Fit, grid: DataFrame, h: int) -> DataFrame:
    """Linear recursion: what does not depend on the target is one number per step; the rest is folded over the tail."""
    by = {p.name: p for p in f.predictors}
    moving = f.spec.of("lag") + f.spec.rolling
    fixed = F.lit(f.model.intercept)
    for p in f.predictors:
        if p.name not in {t.column for t in moving}:
            fixed = fixed + f.model.term(p, F.col(p.name))
    grid = grid.withColumn("__fixed", fixed)
    rows = grid.groupBy(*f.groups).agg(
        F.sort_array(F.collect_list(F.struct("step", F.col(f.date).alias("d"), F.col("__fixed").alias("v")))).alias("__steps"), F.first("__tail").alias("__tail")
    )
    need = f.spec.memory
    empty = F.array().cast("array<double>")

    def next_value(state: Column, step: Column) -> Column:
        y = step["v"]
        for t in moving:
            y = y + f.model.term(by[t.column], target_feature(t, state["tail"]))
        tail = F.concat(state["tail"], F.array(y))
        # the tail stays as long as the longest look back
        return F.struct(F.when(F.size(tail) > need, F.slice(tail, -need, need)).otherwise(tail).alias("tail"), F.concat(state["out"], F.array(y)).alias("out"))

    folded = F.aggregate("__steps", F.struct(F.col("__tail").alias("tail"), empty.alias("out")), next_value, lambda s: s["out"])
    rows = rows.withColumn("__out", folded)
    z = rows.select(*f.groups, F.explode(F.arrays_zip("__steps", "__out")).alias("z"))
    return z.select(*f.groups, F.col("z.__steps.step").alias("step"), F.col("z.__steps.d").alias(f.date), F.col("z.__out").alias("__y"))


def tail_value(kind: str, tail: list, n: int) -> float:
    """The same as ``target_feature``, in Python."""
    if len(tail) < n:
        return np.nan
    if kind == "lag":
        return tail[-n]
    x = np.array(tail[-n:], float)
    ok = ~np.isnan(x)
    v = x[ok]
    if kind == "rollslope":
        i = np.flatnonzero(ok).astype(float)
        if len(v) < 2:
            return np.nan
        d = i - i.mean()
        return float(d @ (v - v.mean()) / (d @ d))
    if kind == "rollsd":
        return float(v.std(ddof=1)) if len(v) > 1 else np.nan
    if not len(v):
        return np.nan
    return float({"ma": np.mean, "rollsum": np.sum, "rollmin": np.min, "rollmax": np.max}[kind](v))


def _stepwise(f: Fit, grid: DataFrame, on_error: str) -> DataFrame:
    """Any model, one series at a time; without target features all rows at once."""
    moving, names, model = f.spec.of("lag") + f.spec.rolling, [p.name for p in f.predictors], f.model
    ready = [n for n in names if n not in {t.column for t in moving}]
    rows = grid.select(*f.groups, f.date, "step", "__tail", *ready)
    kept = [*f.groups, f.date, "step"]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("__y", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step").reset_index(drop=True)
        tail = [np.nan if v is None else float(v) for v in pdf["__tail"].iloc[0]]

        def predict(x: pd.DataFrame) -> np.ndarray:
            try:
                return np.asarray(model.predict_pandas(x[names]), float)
            except Exception:
                if on_error == "raise":
                    raise
                return np.full(len(x), np.nan)

        if not moving:
            return pdf[kept].assign(__y=predict(pdf))
        out = []
        for i in range(len(pdf)):
            x = pdf.iloc[[i]][ready].copy()
            for t in moving:
                x[t.column] = tail_value(t.kind, tail, t.n)
            out.append(predict(x)[0])
            tail.append(out[-1])
        return pdf[kept].assign(__y=out)

    done = rows.groupBy(*f.groups).applyInPandas(run, schema)
    return done.withColumn("__y", F.when(~F.isnan("__y"), F.col("__y")))
