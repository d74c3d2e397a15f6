"""Panel construction: frequency detection, calendar completion, the cleaning pipeline, future dates."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import Frequency, epoch_seconds, is_time_type, step_after, steps_between, weekday
from .features import cleaned, ordered
from .impute import fill_gaps, imputation_summary


def frequency_of(seconds: float, weekend: bool, dates: bool) -> Frequency:
    """The step that a typical distance stands for."""
    if not dates:
        if abs(seconds - 1) < 1:
            return Frequency("second")
        for name, size in (("minute", 60), ("halfhour", 1800), ("hour", 3600)):
            if abs(seconds - size) < 0.1 * size:
                return Frequency(name)
    days = seconds / 86400
    if abs(days - 1) < 0.5:
        return Frequency("day" if weekend else "businessday")
    for name, size, off in (("week", 7, 0.5), ("biweekly", 14, 1)):
        if abs(days - size) < off:
            return Frequency(name)
    for name, low, high in (("month", 28, 31), ("quarter", 89, 92), ("year", 364, 367)):
        if low <= days <= high:
            return Frequency(name)
    if round(days) < 1:
        raise ValueError(f"a step of {seconds:g} seconds is not supported; give a frequency")
    return Frequency(int(round(days)))


def frequency_stats(df: DataFrame, date: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row: median step in seconds (median of the groups' medians), its variation, duplicates, whether weekends occur."""
    keys = list(groups) or [F.lit(0).alias("__all")]
    w = ordered(date, groups)
    t = epoch_seconds(F.col(date))
    steps = df.where(F.col(date).isNotNull()).withColumn("__step", t - F.lag(t).over(w))
    per = steps.groupBy(*keys).agg(
        F.median("__step").alias("m"), F.count_if(F.col("__step") == 0).alias("dup"), F.max(weekday(F.col(date)) >= 5).alias("weekend")
    )
    return per.agg(F.median("m").alias("median_step"), (F.stddev_samp("m") / F.avg("m")).alias("variation"), F.sum("dup").alias("duplicates"), F.max("weekend").alias("weekend"))


def detect_frequency(df: DataFrame, date: str, groups: Sequence[str] = ()) -> Frequency:
    row = frequency_stats(df, date, groups).first()
    if row["median_step"] is None or row["median_step"] == 0:
        raise ValueError("the frequency cannot be told: too few dates, or all equal")
    if row["duplicates"]:
        warnings.warn(f"{row['duplicates']} dates occur more than once in their series", stacklevel=2)
    if row["variation"] is not None and row["variation"] > 0.15:
        warnings.warn("the series differ in their steps", stacklevel=2)
    return frequency_of(row["median_step"], bool(row["weekend"]), df.schema[date].dataType.typeName() == "date")


def time_grid(df: DataFrame, date: str, groups: Sequence[str], freq: Frequency) -> DataFrame:
    """Every step from the first to the last date of each series."""
    kind = df.schema[date].dataType
    span = df.groupBy(*groups).agg(F.min(date).alias("__lo"), F.max(date).alias("__hi")).where(F.col("__lo").isNotNull())
    daily = Frequency("day") if freq.unit == "business" else freq
    k = span.withColumn("__k", F.explode(F.sequence(F.lit(0), steps_between(F.col("__lo"), F.col("__hi"), daily))))
    at = step_after(F.col("__lo"), F.col("__k"), daily, kind)
    return k.withColumn(date, at).where(F.col(date) <= F.col("__hi")).select(*groups, date)


def fill_time(df: DataFrame, date: str, groups: Sequence[str] = (), frequency="day") -> DataFrame:
    """The table with a row for each step of each series; added rows are null elsewhere, rows off the grid stay. Business days: weekends go, observed ones too."""
    freq = Frequency.of(frequency)
    freq.check(df.schema[date].dataType)
    groups = list(groups)
    grid = time_grid(df, date, groups, freq).select(*[F.col(c).alias(f"__g_{c}") for c in groups], F.col(date).alias("__g_date"))
    cond = F.col(date) == F.col("__g_date")
    for c in groups:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    out = df.withColumn("__here", F.lit(True)).join(grid, cond, "full")
    filled = {date: F.coalesce(F.col(date), F.col("__g_date"))} | {c: F.when(F.col("__here").isNull(), F.col(f"__g_{c}")).otherwise(F.col(c)) for c in groups}
    out = out.select(*[filled.get(c, F.col(c)).alias(c) for c in df.columns])
    return out.where(weekday(F.col(date)) < 5) if freq.unit == "business" else out


def future_dates(last: DataFrame, date: str, h: int, frequency) -> DataFrame:
    """Each row of ``last`` h times, ``date`` moved on by 1..h steps, with ``step``."""
    if isinstance(h, bool) or int(h) != h or h < 1:
        raise ValueError("h must be a whole number of 1 or more")
    freq, kind = Frequency.of(frequency), last.schema[date].dataType
    freq.check(kind)
    out = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(int(h)))))
    return out.withColumn(date, step_after(F.col(date), F.col("step"), freq, kind))


def median_step_dates(df: DataFrame, date: str, groups: Sequence[str], h: int) -> DataFrame:
    """Future dates where no frequency is known: the median step of each series in whole days (seconds for timestamps), one day where there is none."""
    kind, w = df.schema[date].dataType, ordered(date, groups)
    t = epoch_seconds(F.col(date))
    steps = df.withColumn("__s", t - F.lag(t).over(w))
    last = steps.groupBy(*groups).agg(F.max(date).alias(date), F.coalesce(F.median("__s"), F.lit(86400.0)).alias("__m"))
    last = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(int(h)))))
    if kind.typeName() == "date":
        moved = F.date_add(F.col(date), (F.col("step") * F.greatest(F.lit(1), F.floor(F.col("__m") / 86400))).cast("int"))
    else:
        moved = F.col(date) + F.make_dt_interval(secs=(F.col("step") * F.col("__m")).cast("decimal(18,6)"))
    return last.withColumn(date, moved).drop("__m")


@dataclass
class TimeSeriesFrame:
    """A cleaned panel with what was done to it."""

    df: DataFrame
    date: str
    groups: list[str] = field(default_factory=list)
    frequency: Frequency | None = None
    target: str | None = None
    meta: dict = field(default_factory=dict)

    @classmethod
    def create(
        cls, df: DataFrame, date: str, groups: Sequence[str] | str | None = None, frequency=None, *, auto_detect: bool = True, target: str | None = None,
        target_na: dict | None = None, fill_time_gaps: bool = False, xreg_na: dict[str, dict] | None = None, validate: bool = True,
    ) -> TimeSeriesFrame:
        """Checks, frequency, calendar completion, target filling, filling of other columns, in this order.

        target_na and the values of xreg_na are keyword arguments of ``fill_gaps``
        with ``strategy``.
        """
        groups = [groups] if isinstance(groups, str) else list(groups or [])
        for c in [date, *groups, *([target] if target else []), *(xreg_na or {})]:
            if c not in df.columns:
                raise ValueError(f"{c!r} is not a column")
        if not is_time_type(df.schema[date].dataType):
            raise TypeError(f"{date!r} must hold dates or timestamps, not {df.schema[date].dataType.simpleString()}")
        df = cleaned(df, [c for c in df.columns if c != date])
        freq = Frequency.of(frequency) if frequency is not None else detect_frequency(df, date, groups) if auto_detect else None
        meta: dict = {}
        if freq is not None:
            freq.check(df.schema[date].dataType)
        if fill_time_gaps:
            if freq is None:
                raise ValueError("calendar completion needs a frequency")
            if validate and df.where(F.col(date).isNull()).limit(1).count():
                raise ValueError(f"{date!r} has missing dates")
            new = fill_time(df, date, groups, freq)
            if validate:
                before, after = df.count(), new.count()
                weekends = df.where(weekday(F.col(date)) >= 5).count() if freq.unit == "business" else 0
                meta["fill_time"] = {"n_added": after - before + weekends, "n_weekends_removed": weekends, "n_net_change": after - before, "n_total": after}
            df = new
        for column, how in ([(target, target_na)] if target and target_na else []) + list((xreg_na or {}).items()):
            df = fill_gaps(df, column, date, groups, validate=validate, **how)
            if validate:
                meta[column] = {"strategy": how.get("strategy", "error")} | imputation_summary(df, column).first().asDict()
        if validate and target and fill_time_gaps and not target_na:
            tails = df.groupBy(*groups).agg(F.max_by(F.col(target).isNull(), date).alias("t")).where("t").limit(1).count()
            if tails:
                warnings.warn(f"a series ends with a missing {target!r}; forecasting needs a last value", stacklevel=2)
        return cls(df, date, groups, freq, target, meta)

    def __repr__(self) -> str:
        lines = [f"TimeSeriesFrame: {', '.join(self.df.columns)}", f"  date: {self.date}", f"  groups: {', '.join(self.groups) or '-'}", f"  frequency: {self.frequency.label if self.frequency else 'unknown'}"]
        for name, m in self.meta.items():
            lines.append(f"  {name}: " + ", ".join(f"{k}={v}" for k, v in m.items()))
        return "\n".join(lines)


def last_dates(df: DataFrame, date: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, date): the last date of each series."""
    return df.groupBy(*groups).agg(F.max(date).alias(date))


def trailing_missing(df: DataFrame, target: str, date: str, groups: Sequence[str] = ()) -> DataFrame:
    """The series whose last target is missing."""
    missing: Column = F.col(target).isNull()
    return cleaned(df, [target]).groupBy(*groups).agg(F.max_by(missing, date).alias("trailing")).where("trailing").drop("trailing")


__all__ = ["TimeSeriesFrame", "detect_frequency", "fill_time", "frequency_of", "frequency_stats", "future_dates", "last_dates", "median_step_dates", "time_grid", "trailing_missing"]
