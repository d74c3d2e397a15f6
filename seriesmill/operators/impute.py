"""Gap filling: nine strategies, each within its own series, with a flag for what was filled.

All but ``stl`` and ``custom`` are window expressions or joins. Checks that must
raise (gaps too long, an edge that cannot be filled) run as one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lending import lend_blocks
from ..functions.stl import stl_fitted
from ..functions.timeaxis import epoch_seconds
from .features import cleaned, ordered

STRATEGIES = ("error", "zero", "locf", "nocb", "linear", "rolling_mean", "stl", "borrow", "custom")

#: Weighted borrowing: values of a block of series, and values that a series counts for besides its own.
BLOCK, SERIES_COSTS = 250_000, 30


def gap_runs(df: DataFrame, column: str, date: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, run, first, length) of each run of nulls: a gap is an island of equal differences of row numbers."""
    w = ordered(date, groups)
    null = F.col(column).isNull()
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*(groups or [F.lit(0)]), null).orderBy(date))
    runs = cleaned(df, [column]).select(*groups, date, column).withColumns({"run": island, "__null": null}).where("__null")
    return runs.groupBy(*groups, "run").agg(F.min(date).alias("first"), F.count("*").alias("length"))


def _check(df: DataFrame, column: str, date: str, groups: Sequence[str], *, lead: bool = False, trail: bool = False, max_gap: float | None = None, least: int = 0) -> None:
    """One action for all conditions; groups without nulls are not looked at."""
    present = F.col(column).isNotNull()
    keys = list(groups) or [F.lit(0).alias("__all")]
    flagged = df.select(*groups, date, column).withColumns(
        {"__seen": F.max(present).over(so_far(date, groups)), "__ahead": F.max(present).over(so_far(date, groups, back=True))}
    )
    per = flagged.groupBy(*keys).agg(
        F.count_if(~present).alias("nulls"), F.count_if(present).alias("values"),
        F.max(~present & ~F.col("__seen")).alias("lead"), F.max(~present & ~F.col("__ahead")).alias("trail"),
    ).where("nulls > 0")
    out = per.agg(F.max("lead"), F.max("trail"), F.min("values")).first()
    if lead and out[0]:
        raise ValueError(f"{column!r} starts with a missing value in some series; {'locf' if not trail else 'linear'} cannot fill it")
    if trail and out[1]:
        raise ValueError(f"{column!r} ends with a missing value in some series; {'nocb' if not lead else 'linear'} cannot fill it")
    if least and out[2] is not None and out[2] < least:
        raise ValueError(f"{column!r} has a series with {out[2]} values; {least} are needed")
    if max_gap is not None and np.isfinite(max_gap):
        longest = gap_runs(df, column, date, groups).agg(F.max("length")).first()[0]
        if longest is not None and longest > max_gap:
            raise ValueError(f"a gap of {longest} in {column!r} is longer than max_gap={max_gap}")


def so_far(date: str, groups: Sequence[str], back: bool = False):
    """The rows up to the current one; from the end of the series if ``back``. A frame that grows is added to row by row; one that shrinks would be read again for each row."""
    w = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(F.col(date).desc() if back else F.col(date))
    return w.rowsBetween(Window.unboundedPreceding, 0)


def locf(y: Column, date: str, groups: Sequence[str]) -> Column:
    return F.last(y, ignorenulls=True).over(so_far(date, groups))


def nocb(y: Column, date: str, groups: Sequence[str]) -> Column:
    return F.last(y, ignorenulls=True).over(so_far(date, groups, back=True))


def linear(y: Column, date: str, groups: Sequence[str]) -> Column:
    """Interpolation over time between neighbours; constant beyond the first and last value."""
    t = epoch_seconds(F.col(date))
    point = F.when(y.isNotNull(), F.struct(t.alias("t"), y.alias("y")))
    a, b = locf(point, date, groups), nocb(point, date, groups)
    between = a["y"] + (b["y"] - a["y"]) * (t - a["t"]) / (b["t"] - a["t"])
    return F.coalesce(y, F.when(a.isNotNull() & b.isNotNull(), between), a["y"], b["y"])


def rolling_mean(y: Column, w, window: int = 7, center: bool = True) -> Column:
    frame = w.rowsBetween(-(window // 2), window // 2) if center else w.rowsBetween(-(window - 1), 0)
    return F.coalesce(y, F.avg(y).over(frame))


def borrow(df: DataFrame, column: str, date: str, groups: Sequence[str], *, method: str = "median", neighbors=None) -> DataFrame:
    """(groups, date, __lent): a value for each missing cell from the other series at that date.

    A missing cell's own series has nothing to lend at its date, so mean and median
    are one aggregation by date, unless each series has lenders of its own.
    ``weighted`` weighs a peer by one over its mean absolute distance to the series
    on shared dates (no shared date: ten times the largest distance); that compares
    every series with missing cells with every other, block against block, which grows
    with the square of the series. neighbors: the lenders' names (first group column),
    or for each series its lenders, which alone are then compared.
    """
    if not groups:
        raise ValueError("borrow needs groups")
    if method not in ("median", "mean", "weighted"):
        raise ValueError(f"unknown method {method!r}")
    if method == "weighted" and not isinstance(neighbors, Mapping):
        return _borrow_weighted(df, column, date, groups, neighbors)
    keys, peers = [f"g_{c}" for c in groups], [f"p_{c}" for c in groups]
    y = F.col(column).cast("double")
    cells = df.where(F.col(column).isNull()).select(*[F.col(c).alias(f"g_{c}") for c in groups], F.col(date).alias("__d"))
    p = df.where(F.col(column).isNotNull()).select(*[F.col(c).alias(f"p_{c}") for c in groups], F.col(date).alias("__d"), y.alias("py"))
    lent = (F.avg("py") if method == "mean" else F.median("py")).alias("__lent")
    if isinstance(neighbors, Mapping):
        kind = df.schema[groups[0]].dataType.simpleString()
        pairs = df.sparkSession.createDataFrame([(s, x) for s, xs in neighbors.items() for x in dict.fromkeys(xs) if x != s], f"{keys[0]} {kind}, {peers[0]} {kind}")
        cells = cells.join(pairs, keys[0])
        out = cells.join(p, ["__d", peers[0]]).groupBy(*keys, "__d").agg(lent)
    else:
        if neighbors is not None:
            p = p.where(F.col(peers[0]).isin(list(neighbors)))
        out = cells.join(p.groupBy("__d").agg(lent), "__d")
    if method == "weighted":
        by = ["__d", peers[0]]
        needy = cells.drop("__d").distinct()
        have = df.where(F.col(column).isNotNull()).select(*[F.col(c).alias(f"h_{c}") for c in groups], F.col(date).alias("__d"), y.alias("gy"))
        have = have.join(needy, _all_equal(keys, [f"h_{c}" for c in groups])).drop(*[f"h_{c}" for c in groups])
        shared = have.join(p, by).where(~_all_equal(keys, peers))
        gap = shared.groupBy(*keys, *peers).agg(F.avg(F.abs(F.col("gy") - F.col("py"))).alias("d"))
        largest = gap.groupBy(*keys).agg(F.max("d").alias("largest"))
        at = cells.join(p, by)
        at = at.join(_renamed(gap, keys + peers, "w"), _all_equal(keys + peers, [f"w{c}" for c in keys + peers]), "left").join(_renamed(largest, keys, "l"), _all_equal(keys, [f"l{c}" for c in keys]), "left")
        w = 1 / (F.coalesce("d", 10 * F.col("largest"), F.lit(1.0)) + 1e-6)
        out = at.groupBy(*keys, "__d").agg((F.sum(w * F.col("py")) / F.sum(w)).alias("__lent"))
    return out.select(*[F.col(f"g_{c}").alias(c) for c in groups], F.col("__d").alias(date), "__lent")


def _borrow_weighted(df: DataFrame, column: str, date: str, groups: Sequence[str], neighbors: Sequence | None) -> DataFrame:
    """Each block of series with missing cells meets each block of lenders in one group; only sums for the missing cells leave it."""
    keys, peers = [f"g_{c}" for c in groups], [f"p_{c}" for c in groups]
    y = F.col(column).cast("double")
    values, names = df.agg(F.count(column), F.approx_count_distinct(F.struct(*groups))).first()
    n = max(1, -(-(values + SERIES_COSTS * names) // BLOCK))
    point = F.when(y.isNotNull(), F.struct(F.col(date).alias("at"), y.alias("y")))
    series = df.where(F.col(date).isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(groups, keys, strict=True)])
    series = series.agg(F.collect_list(point).alias("have"), F.collect_set(F.when(y.isNull(), F.col(date))).alias("missing")).withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(n)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    needy = series.where(F.size("missing") > 0).withColumn("other", every).withColumn("pair", F.col("block") * n + F.col("other")).drop("other")
    lenders = series.where(F.size("have") > 0).drop("missing").withColumnsRenamed(dict(zip(keys, peers, strict=True)))
    if neighbors is not None:
        lenders = lenders.where(F.col(peers[0]).isin(list(neighbors)))
    lenders = lenders.withColumn("other", every).withColumn("pair", F.col("other") * n + F.col("block")).drop("other")
    tasks = min(n * n, 10_000)  # a number, else small groups that take long would be put together
    kinds = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([T.StructField(k, kinds[c]) for k, c in zip([*keys, "__d"], [*groups, date], strict=True)] + [T.StructField(c, T.DoubleType()) for c in ("wy", "w", "far_y", "far", "largest")])
    met = needy.repartition(tasks, "pair").groupBy("pair").cogroup(lenders.repartition(tasks, "pair").groupBy("pair"))
    cells = met.applyInArrow(lambda left, right: lend_blocks(left, right, keys, peers), schema)
    cells = cells.groupBy(*keys, "__d").agg(*[F.sum(c).alias(c) for c in ("wy", "w", "far_y", "far")], F.max("largest").alias("largest"))
    w = F.when(F.col("far") > 0, 1 / (F.coalesce(10 * F.col("largest"), F.lit(1.0)) + 1e-6)).otherwise(F.lit(0.0))
    lent = F.try_divide(F.col("wy") + w * F.col("far_y"), F.col("w") + w * F.col("far"))
    return cells.select(*[F.col(k).alias(c) for c, k in zip(groups, keys, strict=True)], F.col("__d").alias(date), lent.alias("__lent")).where("__lent is not null")


def _renamed(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})


def _all_equal(a: Sequence[str], b: Sequence[str]) -> Column:
    cond = F.lit(True)
    for x, y in zip(a, b, strict=True):
        cond = cond & F.col(x).eqNullSafe(F.col(y))
    return cond


def _infer_period(dates: pd.Series) -> int:
    days = pd.to_datetime(dates).diff().dt.total_seconds().median() / 86400
    if abs(days - 1) < 0.5:
        return 7
    if abs(days - 7) < 0.5:
        return 52
    if 28 <= days <= 31:
        return 12
    raise ValueError("the period cannot be told from the dates; give period=")


def _per_series(df: DataFrame, column: str, date: str, groups: Sequence[str], fill: Callable[[pd.DataFrame], tuple]) -> DataFrame:
    """Runs ``fill`` on each series that has nulls (pandas, sorted); adds __filled and __flag."""
    schema = T.StructType([*df.schema.fields, T.StructField("__filled", T.DoubleType()), T.StructField("__flag", T.BooleanType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date, kind="stable").reset_index(drop=True)
        y = pdf[column].astype(float)
        if y.isna().any():
            values, flags = fill(pdf)
        else:
            values, flags = y, np.zeros(len(y), bool)
        return pdf.assign(__filled=np.asarray(values, float), __flag=np.asarray(flags, bool))

    return df.groupBy(*groups).applyInPandas(run, schema)


def fill_gaps(
    df: DataFrame, target: str, date: str, groups: Sequence[str] = (), strategy: str = "error", *, max_gap: float | None = None, extrapolate: bool = False,
    window: int = 7, center: bool = True, period: int | None = None, robust: bool = True, method: str = "median", neighbors=None, fn: Callable | None = None, params: dict | None = None, validate: bool = True,
) -> DataFrame:
    """The table with ``target`` filled and ``{target}_is_imputed``.

    The flag marks cells that were missing, for borrow only those that were filled.
    ``validate=False`` leaves out the checks that need an action; what cannot be
    filled then stays null.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
    groups = list(groups)
    df = cleaned(df, [target])
    y, w, flag = F.col(target), ordered(date, groups), f"{target}_is_imputed"
    missing = y.isNull()
    if strategy == "error":
        if validate and (n := df.where(missing).count()):
            raise ValueError(f"{target!r} has {n} missing values; choose a strategy to fill them")
        return df.withColumn(flag, F.lit(False))
    if strategy == "zero":
        return df.withColumns({flag: missing, target: F.coalesce(y, F.lit(0).cast(df.schema[target].dataType))})
    if validate:
        _check(df, target, date, groups, lead=strategy == "locf" or (strategy == "linear" and not extrapolate), trail=strategy == "nocb" or (strategy == "linear" and not extrapolate), max_gap=None if strategy == "custom" else max_gap, least=2 if strategy == "linear" else 0)
    if strategy in ("locf", "nocb"):
        return df.withColumns({flag: missing, target: (locf if strategy == "locf" else nocb)(y, date, groups)})
    if strategy == "linear":
        return df.withColumns({flag: missing, target: linear(y.cast("double"), date, groups)})
    if strategy == "rolling_mean":
        return df.withColumns({flag: missing, target: rolling_mean(y.cast("double"), w, window, center)})
    if strategy == "borrow":
        lent = borrow(df, target, date, groups, method=method, neighbors=neighbors)
        right = lent.select(*[F.col(c).alias(f"__k_{c}") for c in groups], F.col(date).alias("__k_date"), "__lent")
        cond = _all_equal(groups, [f"__k_{c}" for c in groups]) & (F.col(date) == F.col("__k_date"))
        out = df.join(right, cond, "left")
        out = out.withColumns({flag: missing & F.col("__lent").isNotNull(), target: F.coalesce(y.cast("double"), F.col("__lent"))})
        return out.select(*df.columns, flag)
    if strategy == "stl":

        def fill(pdf: pd.DataFrame):
            v = pdf[target].astype(float)
            n = period or _infer_period(pdf[date])
            if v.notna().sum() < 2 * n:
                raise ValueError(f"STL needs {2 * n} values of {target!r} in a series, found {v.notna().sum()}")
            at = pd.to_datetime(pdf[date]).astype("int64").to_numpy(float)
            have = v.notna().to_numpy()
            whole = np.interp(at, at[have], v[have].to_numpy())
            return np.where(have, v, stl_fitted(whole, n, robust)), ~have
    else:
        if fn is None:
            raise ValueError("strategy 'custom' needs fn=")

        def fill(pdf: pd.DataFrame):
            values, flags = fn(pdf[target].astype(float).to_numpy(), pdf[date].to_numpy(), params or {})
            if len(values) != len(pdf) or len(flags) != len(pdf):
                raise ValueError("fn must return a value and a flag for each row")
            return values, flags

    out = _per_series(df, target, date, groups, fill)
    return out.withColumns({target: F.col("__filled"), flag: F.col("__flag")}).drop("__filled", "__flag")


def imputation_summary(df: DataFrame, target: str) -> DataFrame:
    """n_imputed, n_total, pct_imputed."""
    n, total = F.count_if(F.col(f"{target}_is_imputed")), F.count(F.lit(1))
    return df.agg(n.alias("n_imputed"), total.alias("n_total"), F.when(total > 0, 100.0 * n / total).otherwise(F.lit(0.0)).alias("pct_imputed"))
