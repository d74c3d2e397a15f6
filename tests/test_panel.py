from datetime import date, datetime, timedelta

import pytest
from helpers import daily, single
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions.timeaxis import Frequency, step_after
from seriesmill.operators.panel import TimeSeriesFrame, detect_frequency, fill_time, frequency_of, future_dates, median_step_dates


def times(spark, step, n=100, start=datetime(2024, 1, 1)):
    return spark.createDataFrame([(start + i * step,) for i in range(n)], "t timestamp_ntz")


@pytest.mark.parametrize("step,name", [(timedelta(hours=1), "hour"), (timedelta(minutes=1), "minute"), (timedelta(minutes=30), "halfhour"), (timedelta(days=1), "day"), (timedelta(seconds=1), "second")])
def test_detect_times(spark, step, name):
    assert detect_frequency(times(spark, step), "t").name == name


def test_detect_dates(spark):
    def of(days):
        return detect_frequency(spark.createDataFrame([(d,) for d in days], "t date"), "t").name

    start = date(2024, 1, 1)
    assert of([start + timedelta(days=i) for i in range(30)]) == "day"
    assert of([d for d in (start + timedelta(days=i) for i in range(60)) if d.weekday() < 5]) == "businessday"
    assert of([start + timedelta(days=7 * i) for i in range(9)]) == "week"
    assert of([start + timedelta(days=14 * i) for i in range(9)]) == "biweekly"
    assert of([date(2024 + i // 12, i % 12 + 1, 1) for i in range(24)]) == "month"
    assert of([date(2020 + i // 4, 3 * (i % 4) + 1, 1) for i in range(12)]) == "quarter"
    assert of([date(2000 + i, 1, 1) for i in range(9)]) == "year"
    assert of([start + timedelta(days=10 * i) for i in range(9)]) == 10


def test_detect_failures(spark):
    with pytest.raises(ValueError):
        detect_frequency(spark.createDataFrame([(date(2024, 1, 1),)], "t date"), "t")
    with pytest.warns(UserWarning, match="more than once"):
        detect_frequency(spark.createDataFrame([(date(2024, 1, i),) for i in (1, 2, 2, 3, 4, 5, 6)], "t date"), "t")


@pytest.mark.parametrize("bad", ["hourly", "daily", "seconds", 0, -3, None, True])
def test_bad_frequencies(bad):
    with pytest.raises(ValueError):
        Frequency.of(bad)


def test_sub_daily_needs_timestamps(spark):
    with pytest.raises(ValueError):
        fill_time(single(spark, [1, 2]), "date", frequency="hour")


def test_grid(spark):
    df = spark.createDataFrame([(date(2020, 1, d), float(d)) for d in (1, 2, 5, 6)], "date date, value double")
    out = fill_time(df, "date").orderBy("date").collect()
    assert len(out) == 6 and out[2].value is None
    stores = spark.createDataFrame([(s, date(2020, 1, d), 1.0) for s, skip in (("A", 3), ("B", 4)) for d in range(1, 6) if d != skip], "s string, date date, value double")
    assert fill_time(stores, "date", ["s"]).count() == 10
    weeks = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 8, 22)], "date date")
    assert fill_time(weeks, "date", frequency="week").count() == 4
    two = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 15),), (date(2024, 2, 12),)], "date date")
    assert fill_time(two, "date", frequency="biweekly").count() == 4
    hours = spark.createDataFrame([(datetime(2024, 1, 1, h),) for h in (0, 1, 4, 5)], "date timestamp_ntz")
    assert fill_time(hours, "date", frequency="hour").count() == 6


def test_grid_keeps_rows_off_the_grid_and_null_groups(spark):
    df = spark.createDataFrame([(None, date(2024, 1, 1)), (None, date(2024, 1, 4)), ("a", date(2024, 1, 1)), ("a", date(2024, 1, 8)), ("a", date(2024, 1, 10))], "s string, date date")
    assert fill_time(df, "date", ["s"], "day").where("s is null").count() == 4
    assert fill_time(df, "date", ["s"], "week").where("s = 'a'").count() == 3


def test_business_days_lose_observed_weekends(spark):
    ts = TimeSeriesFrame.create(single(spark, range(7), start=date(2024, 1, 5)), "date", frequency="businessday", fill_time_gaps=True)
    assert ts.df.count() == 5 and ts.meta["fill_time"]["n_weekends_removed"] == 2


def ahead(spark, start, freq, h, kind="timestamp_ntz"):
    return [r.t for r in future_dates(spark.createDataFrame([(start,)], f"t {kind}"), "t", h, freq).orderBy("step").collect()]


def test_future_dates(spark):
    assert ahead(spark, date(2024, 1, 5), "businessday", 5, "date") == [date(2024, 1, d) for d in (8, 9, 10, 11, 12)]
    assert ahead(spark, date(2024, 1, 6), "businessday", 2, "date") == [date(2024, 1, 8), date(2024, 1, 9)]
    noon = datetime(2024, 1, 1, 12)
    assert ahead(spark, noon, "hour", 5)[-1] == datetime(2024, 1, 1, 17)
    assert ahead(spark, noon, "minute", 5)[-1] == datetime(2024, 1, 1, 12, 5)
    assert ahead(spark, noon, "halfhour", 4)[-1] == datetime(2024, 1, 1, 14)
    assert ahead(spark, date(2024, 1, 1), "biweekly", 3, "date") == [date(2024, 1, 15), date(2024, 1, 29), date(2024, 2, 12)]
    assert ahead(spark, date(2020, 1, 31), "month", 3, "date") == [date(2020, 3, 2), date(2020, 3, 31), date(2020, 5, 1)]
    assert ahead(spark, date(2024, 1, 1), "quarter", 2, "date") == [date(2024, 4, 1), date(2024, 7, 1)]
    assert ahead(spark, date(2024, 2, 29), "year", 1, "date") == [date(2025, 3, 1)]
    assert ahead(spark, date(2024, 1, 1), 10, 2, "date") == [date(2024, 1, 11), date(2024, 1, 21)]
    assert ahead(spark, datetime(2024, 1, 31, 6), "month", 1) == [datetime(2024, 3, 2, 6)]
    with pytest.raises(ValueError):
        ahead(spark, date(2024, 1, 1), "day", 0, "date")


def test_business_steps_against_plain_loop(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(14)]
    df = spark.createDataFrame([(d, k) for d in days for k in (1, 3, 8)], "d date, k int")
    for r in df.withColumn("x", step_after(F.col("d"), F.col("k"), Frequency("businessday"), T.DateType())).collect():
        d, left = r.d, r.k
        while left:
            d += timedelta(days=1)
            left -= d.weekday() < 5
        assert r.x == d, r


def test_median_steps(spark):
    out = median_step_dates(spark.createDataFrame([(date(2024, 1, d),) for d in (1, 4, 7)], "t date"), "t", [], 2)
    assert [r.t for r in out.orderBy("step").collect()] == [date(2024, 1, 10), date(2024, 1, 13)]


def test_pipeline(spark):
    df = spark.createDataFrame(
        [(s, date(2024, 1, d), v, p) for s, rows in {"A": [(1, 1.0, 5.0), (2, None, None), (4, 4.0, 8.0)], "B": [(1, 1.0, 5.0), (3, 3.0, 7.0), (4, 4.0, 8.0)]}.items() for d, v, p in rows],
        "store string, date date, sales double, price double",
    )
    ts = TimeSeriesFrame.create(df, "date", "store", "day", target="sales", fill_time_gaps=True, target_na={"strategy": "zero"}, xreg_na={"price": {"strategy": "linear"}})
    assert ts.df.count() == 8 and ts.df.where("sales is null or price is null").count() == 0
    assert ts.meta["fill_time"]["n_added"] == 2 and ts.meta["sales"]["n_imputed"] == 3
    assert {"sales_is_imputed", "price_is_imputed"} <= set(ts.df.columns) and "day" in repr(ts)
    got = {(r.store, r.date.day): r.price for r in ts.df.collect()}
    assert got["A", 2] == pytest.approx(6) and got["A", 3] == pytest.approx(7) and got["B", 2] == pytest.approx(6)


def test_trailing_warning_and_checks(spark):
    with pytest.warns(UserWarning, match="ends with a missing"):
        TimeSeriesFrame.create(single(spark, [1, 2, None]), "date", frequency="day", target="value", fill_time_gaps=True)
    with pytest.raises(TypeError):
        TimeSeriesFrame.create(single(spark, [1]).withColumn("date", F.lit(3)), "date")
    with pytest.raises(ValueError):
        TimeSeriesFrame.create(single(spark, [1]), "nope")
    empty = TimeSeriesFrame.create(daily(spark, {}), "date", "series", "day", fill_time_gaps=True)
    assert empty.df.count() == 0


def test_bounds_of_names_are_strict():
    assert [frequency_of(x * 86400, True, True).name for x in (6.5, 7.4, 13, 13.5, 15, 28, 31, 92)] == [6, "week", 13, "biweekly", 15, "month", "month", "quarter"]
    assert frequency_of(57, True, False).name == "minute" and frequency_of(60 * 86400, True, False).name == 60
    with pytest.raises(ValueError):
        frequency_of(54, True, False)
    with pytest.raises(ValueError, match="whole"):
        Frequency.of(1.5)
    assert Frequency.of(3.0).name == 3
