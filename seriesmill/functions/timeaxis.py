"""Frequencies and date arithmetic as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit and number of units of a step.
STEPS = {
    "second": ("second", 1),
    "minute": ("second", 60),
    "halfhour": ("second", 1800),
    "hour": ("second", 3600),
    "day": ("day", 1),
    "businessday": ("business", 1),
    "week": ("day", 7),
    "biweekly": ("day", 14),
    "month": ("month", 1),
    "quarter": ("month", 3),
    "year": ("month", 12),
}

# Seasonal periods of a frequency, shortest first.
PERIODS = {
    "second": (60, 3600, 86400, 604800),
    "minute": (60, 1440, 10080),
    "halfhour": (48, 336, 17532),
    "hour": (24, 168, 8766),
    "day": (7, 365),
    "businessday": (5, 260),
    "week": (52,),
    "biweekly": (26,),
    "month": (12,),
    "quarter": (4,),
    "year": (1,),
}

SUB_DAILY = ("second", "minute", "halfhour", "hour")


@dataclass(frozen=True)
class Frequency:
    """A named step, or a number of days."""

    name: str | int

    @classmethod
    def of(cls, value) -> Frequency:
        if isinstance(value, Frequency):
            return value
        if isinstance(value, bool) or not isinstance(value, (str, int, float)):
            raise ValueError(f"frequency must be one of {', '.join(STEPS)} or a number of days, not {value!r}")
        if isinstance(value, str):
            if value not in STEPS:
                raise ValueError(f"unknown frequency {value!r}; known are {', '.join(STEPS)}, or a positive number of days")
            return cls(value)
        if not value >= 1:
            raise ValueError(f"a frequency in days must be 1 or more, not {value}")
        if int(value) != value:
            raise ValueError(f"a frequency in days must be a whole number, not {value}")
        return cls(int(value))

    @property
    def unit(self) -> str:
        return STEPS[self.name][0] if isinstance(self.name, str) else "day"

    @property
    def step(self) -> int:
        return STEPS[self.name][1] if isinstance(self.name, str) else self.name

    @property
    def sub_daily(self) -> bool:
        return self.unit == "second"

    @property
    def label(self) -> str:
        names = {"halfhour": "30 minutes", "businessday": "business day", "biweekly": "14 days"}
        return names.get(self.name, self.name) if isinstance(self.name, str) else f"{self.name} days"

    @property
    def seconds(self) -> float:
        """Length of a step, months and years as averages."""
        return self.step * {"second": 1, "day": 86400, "business": 86400, "month": 2629800}[self.unit]

    @property
    def periods(self) -> tuple[int, ...]:
        return PERIODS[self.name] if isinstance(self.name, str) else (max(1, round(365.25 / self.name)),)

    def check(self, kind: T.DataType) -> None:
        if self.sub_daily and isinstance(kind, T.DateType):
            raise ValueError(f"frequency {self.name!r} needs a timestamp column, not dates")


def is_time_type(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def epoch_seconds(date: Column) -> Column:
    """Seconds since 1970 of a date or timestamp, as a double."""
    return F.call_function("datediff", date.cast("date"), F.lit("1970-01-01").cast("date")) * F.lit(86400.0) + (
        F.hour(date.cast("timestamp_ntz")) * 3600 + F.minute(date.cast("timestamp_ntz")) * 60 + F.extract(F.lit("second"), date.cast("timestamp_ntz")).cast("double")
    )


def weekday(date: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(date.cast("date"))


def step_after(date: Column, k: Column, freq: Frequency, kind: T.DataType) -> Column:
    """The date k steps on.

    Months overflow: January 31 and a month is March 2 or 3, not the end of
    February. A business day counts from the Friday before, on a weekend.
    """
    k = k.cast("int")
    n = k * freq.step
    if freq.unit == "second":
        return date + F.make_dt_interval(secs=n.cast("decimal(18,6)"))
    if freq.unit == "day":
        return F.date_add(date, n) if isinstance(kind, T.DateType) else date + F.make_dt_interval(days=n)
    if freq.unit == "month":
        day = date.cast("date")
        moved = F.date_add(F.add_months(F.trunc(day, "MM"), n), F.dayofmonth(day) - 1)
    else:
        day = date.cast("date")
        wd = F.least(weekday(date), F.lit(4))
        monday = F.date_sub(day, weekday(date))
        total = wd + k
        moved = F.date_add(monday, (F.floor(total / 5) * 7 + F.pmod(total, F.lit(5))).cast("int"))
    if isinstance(kind, T.DateType):
        return moved
    return moved.cast(kind) + (date - F.date_trunc("day", date).cast(kind))


def steps_between(low: Column, high: Column, freq: Frequency) -> Column:
    """An upper bound of the steps from low to high."""
    days = F.call_function("datediff", high.cast("date"), low.cast("date"))
    if freq.unit == "second":
        return F.ceil((epoch_seconds(high) - epoch_seconds(low)) / freq.step).cast("int")
    if freq.unit == "month":
        return F.ceil(F.months_between(high.cast("date"), low.cast("date")) / freq.step).cast("int") + 1
    if freq.unit == "business":
        return days
    return F.ceil(days / F.lit(freq.step)).cast("int") + 1
