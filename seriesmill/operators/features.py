"""Feature generators: window expressions over one ordering of the panel.

All features of a call share one window specification, so a plan has one exchange
and one sort. Windows are counted in rows, end at the current row and are null
until they are full; nulls inside a full window are skipped.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeaxis import is_time_type, weekday
from ..plans.formula import FeatureSpec, Term

STATS = ("sum", "sd", "min", "max")


def cleaned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN becomes null in the given floating columns."""
    kinds = {f.name: f.dataType for f in df.schema}
    new = {c: F.when(~F.isnan(c), F.col(c)) for c in columns if isinstance(kinds.get(c), (T.DoubleType, T.FloatType))}
    return df.withColumns(new) if new else df


def numeric(df: DataFrame, column: str) -> Column:
    """The column as a double; text raises, since averaging labels is a mistake."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        raise TypeError(f"{column!r} is {kind.simpleString()}, not a number")
    return F.col(column).cast("double")


def ordered(date: str, groups: Sequence[str] = ()) -> WindowSpec:
    return (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy(date)


def full(value: Column, w: WindowSpec, n: int, lag: int = 0) -> tuple[Column, WindowSpec]:
    frame = w.rowsBetween(-(n - 1) - lag, -lag)
    return F.count(F.lit(1)).over(frame) == n, frame


def windowed(kind: str, value: Column, w: WindowSpec, n: int, lag: int = 0) -> Column:
    """A rolling statistic of the last n rows (``lag`` rows back, 0 by default)."""
    ready, frame = full(value, w, n, lag)
    if kind == "rollslope":
        return F.when(ready, F.regr_slope(value, F.col("__row")).over(frame))
    agg = {"ma": F.avg, "rollsum": F.sum, "rollsd": F.stddev_samp, "rollmin": F.min, "rollmax": F.max}[kind]
    return F.when(ready, agg(value).over(frame))


def calendar(kind: str, date: Column, dtype: T.DataType) -> Column:
    """dow and month are text (categories), the rest whole numbers."""
    if kind in ("hod", "moh") and isinstance(dtype, T.DateType):
        warnings.warn(f"{kind}() of a date is always 0", stacklevel=3)
        return F.lit(0)
    return {
        "dow": lambda: (weekday(date) + 1).cast("string"),
        "month": lambda: F.date_format(date, "MM"),
        "dom": lambda: F.dayofmonth(date),
        "eom": lambda: (date.cast("date") == F.last_day(date.cast("date"))).cast("int"),
        "woy": lambda: F.weekofyear(date),
        "hod": lambda: F.hour(date),
        "moh": lambda: F.minute(date),
    }[kind]()


def trend_value(row: Column, degree: int) -> Column:
    return row.cast("int") if degree == 1 else F.pow(row.cast("double"), F.lit(float(degree)))


def apply_terms(df: DataFrame, terms: Sequence[Term], date: str, groups: Sequence[str], window_lag: int = 0) -> DataFrame:
    """Adds the columns of ``terms``; window_lag=1 makes windows of the target end at the row before."""
    terms = [t for t in terms if t.kind != "raw"]
    sources = [t.source for t in terms if t.kind not in ("trend", "cal")]
    df = cleaned(df, list(dict.fromkeys(sources)))
    w = ordered(date, groups)
    dtype = df.schema[date].dataType
    if any(t.kind in ("trend", "rollslope") for t in terms):
        df = df.withColumn("__row", F.row_number().over(w))
    new: dict[str, Column] = {}
    for t in terms:
        if t.kind == "cal":
            new[t.column] = calendar(t.kind if t.kind != "cal" else t.column, F.col(date), dtype)
        elif t.kind == "trend":
            new[t.column] = trend_value(F.col("__row"), t.n)
        elif t.kind in ("lag", "xlag"):
            new[t.column] = F.lag(t.source, t.n).over(w) if t.n else F.col(t.source)
        elif t.kind == "xma":
            new[t.column] = windowed("ma", numeric(df, t.source), w, t.n)
        else:
            new[t.column] = windowed(t.kind, numeric(df, t.source), w, t.n, window_lag)
    return df.withColumns(new).drop("__row") if new else df.drop("__row")


def build_features(df: DataFrame, spec: FeatureSpec, date: str, groups: Sequence[str] = (), window_lag: int = 0) -> DataFrame:
    """All columns of a formula."""
    return apply_terms(df, spec.terms, date, groups, window_lag)


def positive(values: Sequence[int], least: int, what: str) -> list[int]:
    if any(isinstance(v, bool) or int(v) != v or v < least for v in values):
        raise ValueError(f"{what} must be whole numbers of {least} or more, not {list(values)}")
    return sorted({int(v) for v in values})


def add_lags_ma(
    df: DataFrame, date: str, target: str, *, p: Sequence[int] = (), q: Sequence[int] = (), groups: Sequence[str] = (),
    xreg_lags: dict[str, Sequence[int]] | None = None, xreg_ma: dict[str, Sequence[int]] | None = None,
) -> DataFrame:
    """Lags ``{y}_lag_{L}`` (p lists the lags) and moving averages ``{y}_ma_{w}``, of the target and of other columns."""
    terms = [Term("lag", f"{target}_lag_{n}", target, n) for n in positive(p, 1, "lags")]
    terms += [Term("ma", f"{target}_ma_{n}", target, n) for n in positive(q, 1, "windows")]
    for x, ns in (xreg_lags or {}).items():
        terms += [Term("xlag", f"{x}_lag_{n}", x, n) for n in positive(ns, 0, "lags") if n]
    for x, ns in (xreg_ma or {}).items():
        terms += [Term("xma", f"{x}_ma_{n}", x, n) for n in positive(ns, 1, "windows")]
    return apply_terms(df, terms, date, groups)


def add_rolling(df: DataFrame, date: str, target: str, *, groups: Sequence[str] = (), windows: Sequence[int] = (7, 28), stats: Sequence[str] = STATS, trend_windows: Sequence[int] = ()) -> DataFrame:
    """Rolling ``{y}_rollsum_{w}``, sd, min, max and slopes."""
    if bad := set(stats) - set(STATS):
        raise ValueError(f"unknown statistics {sorted(bad)}")
    terms = [Term(f"roll{s}", f"{target}_roll{s}_{n}", target, n) for n in positive(windows, 1, "windows") for s in stats]
    terms += [Term("rollslope", f"{target}_rollslope_{n}", target, n) for n in positive(trend_windows, 2, "slope windows")]
    return apply_terms(df, terms, date, groups)


def add_calendar(df: DataFrame, date: str, *, dow: bool = True, woy: bool = False, month: bool = True, eom: bool = True, dom: bool = False, hod: bool = False, moh: bool = False) -> DataFrame:
    if not is_time_type(df.schema[date].dataType):
        warnings.warn(f"{date!r} is not a date; no calendar columns", stacklevel=2)
        return df
    wanted = {"dow": dow, "woy": woy, "month": month, "eom": eom, "dom": dom, "hod": hod, "moh": moh}
    return apply_terms(df, [Term("cal", c) for c, on in wanted.items() if on], date, ())


def add_trend(df: DataFrame, date: str, *, groups: Sequence[str] = (), degrees: Sequence[int] = (1,)) -> DataFrame:
    """``trend{d}``: the row number within the group to the power d."""
    return apply_terms(df, [Term("trend", f"trend{d}", "", d) for d in positive(degrees, 1, "degrees")], date, groups)


#: Holiday tables larger than this are joined by a shuffle.
BROADCAST_HOLIDAYS = 100_000


def add_holidays(df: DataFrame, date: str, holidays: DataFrame, column: str = "holiday") -> DataFrame:
    """``holiday`` 0/1 from a table whose first column holds the dates; its other columns come along, null elsewhere."""
    first, *rest = holidays.columns
    h = holidays.select(F.col(first).cast("date").alias("__day"), *[F.col(c) for c in rest], F.lit(1).alias(column)).where(F.col("__day").isNotNull()).dropDuplicates(["__day"])
    if h.count() <= BROADCAST_HOLIDAYS:
        h = F.broadcast(h)
    out = df.withColumn("__day", F.col(date).cast("date")).join(h, "__day", "left").drop("__day")
    return out.withColumn(column, F.coalesce(column, F.lit(0)))
