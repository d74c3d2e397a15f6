"""Pooled models over the feature columns of all series.

``OLS`` is fitted from one aggregation of cross products, whatever the number of
rows; its predictions are column expressions. Any object with ``fit(y, X)`` and
``predict(model, X)`` over pandas can take its place (``PandasModel``), and MLlib
regressors go through ``MLModel``.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Predictor:
    """Name, type and, for text columns, the levels seen in training (sorted)."""

    name: str
    kind: str
    levels: tuple[str, ...] = ()


def capture_schema(df: DataFrame, columns: Sequence[str]) -> list[Predictor]:
    """The recorded predictors; the levels of all text columns come from one aggregation."""
    kinds = {c: df.schema[c].dataType for c in columns}
    text = [c for c in columns if isinstance(kinds[c], T.StringType)]
    levels = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in text]).first().asDict() if text else {}
    return [Predictor(c, kinds[c].simpleString(), tuple(levels.get(c) or ())) for c in columns]


def harmonise(df: DataFrame, predictors: Sequence[Predictor], keep: Sequence[str] = ()) -> DataFrame:
    """The predictors in training order and type: missing ones null, unseen levels null, others dropped."""
    out = []
    for p in predictors:
        c = F.col(p.name).cast(p.kind) if p.name in df.columns else F.lit(None).cast(p.kind)
        out.append((F.when(c.isin(list(p.levels)), c) if p.levels else c).alias(p.name))
    return df.select(*keep, *out)


def warn_unseen(df: DataFrame, predictors: Sequence[Predictor]) -> None:
    """Says which text predictors hold values that training had not; one aggregation, and none without such predictors."""
    known = [p for p in predictors if p.levels and p.name in df.columns]
    if not known:
        return
    row = df.agg(*[F.count_if(~F.col(p.name).isin(list(p.levels))).alias(p.name) for p in known]).first()
    for p in known:
        if row[p.name]:
            warnings.warn(f"{p.name!r}: {row[p.name]} values were not seen in training and count as missing", stacklevel=3)


def design(predictors: Sequence[Predictor]) -> list[tuple[str, Column]]:
    """Columns of the design matrix without the intercept; the first level of a text column is its baseline, nulls stay null."""
    out: list[tuple[str, Column]] = []
    for p in predictors:
        if p.kind == "string":
            out += [(f"{p.name}{v}", F.when(F.col(p.name).isNotNull(), (F.col(p.name) == v).cast("double"))) for v in p.levels[1:]]
        else:
            out.append((p.name, F.col(p.name).cast("double")))
    return out


@dataclass
class LinearFit:
    """Coefficients by design column; aliased columns have none."""

    intercept: float
    coef: dict[str, float]
    predictors: list[Predictor] = field(default_factory=list)

    def expression(self, columns: dict[str, Column] | None = None) -> Column:
        """The prediction; null where a predictor is. ``columns`` replaces predictors by other expressions."""
        total = F.lit(self.intercept)
        for p in self.predictors:
            total = total + self.term(p, (columns or {}).get(p.name, F.col(p.name)))
        return total

    def term(self, p: Predictor, c: Column) -> Column:
        if p.kind != "string":
            return c.cast("double") * F.lit(self.coef.get(p.name, 0.0))
        value = F.when(c.isin(list(p.levels)), F.lit(0.0))
        for v in p.levels[1:]:
            value = value + F.when(c == v, F.lit(self.coef.get(f"{p.name}{v}", 0.0))).otherwise(F.lit(0.0))
        return value

    def predict_pandas(self, x: pd.DataFrame) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for p in self.predictors:
            if p.kind == "string":
                v = x[p.name]
                codes = v.map({level: self.coef.get(f"{p.name}{level}", 0.0) if i else 0.0 for i, level in enumerate(p.levels)})
                total = total + codes.to_numpy(float)
            else:
                total = total + x[p.name].to_numpy(float) * self.coef.get(p.name, 0.0)
        return total


class OLS:
    """Ordinary least squares with an intercept; collinear columns are dropped in order."""

    def __init__(self, tolerance: float = 1e-10):
        self.tolerance = tolerance

    def fit_frame(self, df: DataFrame, target: str, predictors: list[Predictor]) -> LinearFit:
        cols = design(predictors)
        names = [n for n, _ in cols]
        x = df.select(F.col(target).cast("double").alias("__y"), *[c.alias(f"__x{i}") for i, (_, c) in enumerate(cols)])
        every = ["__y", *[f"__x{i}" for i in range(len(cols))]]
        # covariances are summed around the running means, so that powers of a trend stay apart in one pass
        pairs = [(i, j) for i in range(len(every)) for j in range(i, len(every))]
        means = x.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in every], *[F.covar_pop(every[i], every[j]).alias(f"{i}_{j}") for i, j in pairs]).first()
        if not means["n"]:
            raise ValueError("no training rows are left; the series are shorter than the features need")
        gram = np.zeros((len(every), len(every)))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = means["n"] * means[f"{i}_{j}"]
        coef = solve_gram(gram[1:, 1:], gram[1:, 0], self.tolerance)
        intercept = means["__y"] - sum(b * means[f"__x{i}"] for i, b in enumerate(coef) if b is not None)
        return LinearFit(float(intercept), {n: float(b) for n, b in zip(names, coef, strict=True) if b is not None}, predictors)


def solve_gram(a: np.ndarray, b: np.ndarray, tolerance: float) -> list[float | None]:
    """Coefficients from centred cross products; None for a column that those before it determine."""
    keep: list[int] = []
    for j in range(len(a)):
        left = a[j, j]
        if keep and left > 0:
            k = np.ix_(keep, keep)
            left = left - a[j, keep] @ np.linalg.solve(a[k], a[keep, j])
        if a[j, j] > 0 and left > tolerance * a[j, j]:
            keep.append(j)
    out: list[float | None] = [None] * len(a)
    if keep:
        scale = np.sqrt(np.diag(a)[keep])
        k = a[np.ix_(keep, keep)] / np.outer(scale, scale)
        for j, v in zip(keep, np.linalg.solve(k, b[keep] / scale) / scale, strict=True):
            out[j] = float(v)
    return out


class PandasModel:
    """A model given by two functions over pandas: fit(y, X, **extra) and predict(model, X).

    It is fitted on the driver, so training rows above ``max_rows`` raise instead of
    filling the driver; text columns come as categories.
    """

    def __init__(self, fit: Callable[..., Any], predict: Callable[[Any, pd.DataFrame], Any], max_rows: int = 5_000_000, **extra):
        self.fit, self.predict, self.max_rows, self.extra = fit, predict, max_rows, extra

    @classmethod
    def from_estimator(cls, make: Callable[[], Any], **extra) -> PandasModel:
        """For classes with ``fit(X, y)`` and ``predict(X)``; text columns become dummies."""

        def encoded(x: pd.DataFrame) -> np.ndarray:
            return pd.get_dummies(x, drop_first=True, dtype=float).to_numpy(float)

        return cls(lambda y, x, **kw: make().fit(encoded(x), y, **kw), lambda m, x: m.predict(encoded(x)), **extra)

    def fit_frame(self, df: DataFrame, target: str, predictors: list[Predictor]) -> PandasFit:
        x = df.select(target, *[p.name for p in predictors])
        if x.limit(self.max_rows + 1).count() > self.max_rows:
            raise ValueError(f"more than {self.max_rows} training rows; use OLS or MLModel, which are fitted on the cluster")
        pdf = x.toPandas()
        if not len(pdf):
            raise ValueError("no training rows are left; the series are shorter than the features need")
        model = self.fit(pdf[target].to_numpy(float), typed(pdf, predictors), **self.extra)
        return PandasFit(model, self.predict, predictors)


def typed(pdf: pd.DataFrame, predictors: Sequence[Predictor]) -> pd.DataFrame:
    return pd.DataFrame({p.name: pd.Categorical(pdf[p.name], categories=list(p.levels)) if p.levels else pdf[p.name] for p in predictors}, index=pdf.index)


@dataclass
class PandasFit:
    model: Any
    predict: Callable[[Any, pd.DataFrame], Any]
    predictors: list[Predictor]

    def predict_pandas(self, x: pd.DataFrame) -> np.ndarray:
        """Predictions; rows with a missing predictor get none."""
        x = typed(x, self.predictors)
        out = np.full(len(x), np.nan)
        whole = x.notna().all(axis=1).to_numpy()
        if whole.any():
            out[whole] = np.asarray(self.predict(self.model, x[whole]), float)
        return np.where(np.isfinite(out), out, np.nan)


class Ensemble:
    """A weighted mean of models; without weights, all alike."""

    def __init__(self, models: Sequence[Any], weights: Sequence[float] | None = None):
        self.models = list(models)
        w = np.ones(len(self.models)) if weights is None else np.asarray(weights, float)
        self.weights = w / w.sum()

    @classmethod
    def inverse_error(cls, models: Sequence[Any], errors: Sequence[float]) -> Ensemble:
        """Weights of one over each model's error."""
        return cls(models, 1 / np.asarray(errors, float))

    def fit_frame(self, df: DataFrame, target: str, predictors: list[Predictor]) -> EnsembleFit:
        return EnsembleFit([m.fit_frame(df, target, predictors) for m in self.models], self.weights, predictors)


@dataclass
class EnsembleFit:
    fits: list[Any]
    weights: np.ndarray
    predictors: list[Predictor]

    def predict_pandas(self, x: pd.DataFrame) -> np.ndarray:
        return sum(w * f.predict_pandas(x) for w, f in zip(self.weights, self.fits, strict=True))


class MLModel:
    """An MLlib regressor, trained on the cluster: GeneralizedLinearRegression, RandomForestRegressor, GBTRegressor, ..."""

    def __init__(self, regressor):
        self.regressor = regressor

    def fit_frame(self, df: DataFrame, target: str, predictors: list[Predictor]) -> PandasFit:
        from pyspark.ml.feature import VectorAssembler

        cols = design(predictors)
        x = df.select(F.col(target).cast("double").alias("label"), *[c.alias(f"x{i}") for i, (_, c) in enumerate(cols)])
        data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(cols))], outputCol="features").transform(x)
        model = self.regressor.setLabelCol("label").setFeaturesCol("features").fit(data)
        return PandasFit(_portable(model), _predict_portable, predictors)


def _portable(model) -> dict:
    """What executors need of an MLlib model, as plain values: linear coefficients or trees."""
    if hasattr(model, "coefficients"):
        link = model.getOrDefault("link") if model.hasParam("link") and model.isDefined("link") else "identity"
        return {"kind": "linear", "w": list(model.coefficients), "b": float(model.intercept), "link": link}
    if hasattr(model, "trees"):
        return {"kind": "trees", "trees": [_tree(t._call_java("rootNode")) for t in model.trees], "weights": list(model.treeWeights), "mean": "Forest" in type(model).__name__}
    return {"kind": "trees", "trees": [_tree(model._call_java("rootNode"))], "weights": [1.0], "mean": True}


def _tree(node) -> tuple:
    if node.subtreeDepth() == 0:
        return (node.prediction(),)
    split = node.split()
    if not hasattr(split, "threshold"):
        raise TypeError("trees with categorical splits are not supported")
    return (split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


def _predict_portable(model: dict, x: pd.DataFrame) -> np.ndarray:
    parts = []
    for c in x.columns:
        if isinstance(x[c].dtype, pd.CategoricalDtype):
            parts += [(x[c] == v).to_numpy(float) for v in x[c].cat.categories[1:]]
        else:
            parts.append(x[c].to_numpy(float))
    m = np.column_stack(parts) if parts else np.empty((len(x), 0))
    if model["kind"] == "linear":
        eta = m @ np.array(model["w"]) + model["b"]
        return {"log": np.exp, "identity": lambda v: v, "inverse": lambda v: 1 / v, "sqrt": np.square, "logit": lambda v: 1 / (1 + np.exp(-v))}[model["link"]](eta)

    def walk(tree: tuple, at: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(at), tree[0])
        left = m[at, tree[0]] <= tree[1]
        out = np.empty(len(at))
        out[left], out[~left] = walk(tree[2], at[left]), walk(tree[3], at[~left])
        return out

    total = sum(w * walk(t, np.arange(len(m))) for w, t in zip(model["weights"], model["trees"], strict=True))
    return total / sum(model["weights"]) if model["mean"] else total
