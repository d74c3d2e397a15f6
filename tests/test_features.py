from datetime import date, datetime
from itertools import pairwise

import numpy as np
import pytest
from helpers import column, daily, single
from pyspark.sql import functions as F

from seriesmill.operators.features import add_calendar, add_holidays, add_lags_ma, add_rolling, add_trend


def test_ma_stays_within_its_group(spark):
    out = add_lags_ma(daily(spark, {"A": [10] * 10, "B": [100] * 10}), "date", "value", q=[3], groups=["series"])
    assert column(out, "value_ma_3", where="series = 'A'") == [None, None] + [10.0] * 8
    assert column(out, "value_ma_3", where="series = 'B'")[2] == 100.0


def test_rollsum_and_lag(spark):
    df = daily(spark, {"A": range(1, 11), "B": range(101, 111)})
    out = add_rolling(df, "date", "value", groups=["series"], windows=[3], stats=["sum"])
    assert column(out, "value_rollsum_3", where="series = 'A'")[2] == 6 and column(out, "value_rollsum_3", where="series = 'B'")[2] == 306
    out = add_lags_ma(df, "date", "value", p=[1], groups=["series"])
    assert column(out, "value_lag_1", where="series = 'B'")[:2] == [None, 101.0]


def test_lag_list_is_not_expanded(spark):
    out = add_lags_ma(single(spark, range(1, 11)), "date", "value", p=[1, 3, 5])
    r = out.orderBy("date").collect()[5]
    assert (r.value_lag_1, r.value_lag_3, r.value_lag_5) == (5, 3, 1)
    assert add_lags_ma(single(spark, range(5)), "date", "value", p=[4]).columns[-1] == "value_lag_4"


def test_nulls_inside_full_windows(spark):
    y = [10, 20, 30, None, None, None, None, None, 60, 70, 80, 90]
    out = add_rolling(single(spark, y), "date", "value", windows=[5], stats=["sum", "sd", "min", "max"])
    assert column(out, "value_rollsum_5")[4:8] == [60.0, 50.0, 30.0, None]
    assert column(out, "value_rollsd_5")[5] == pytest.approx(7.0710678, abs=1e-6) and column(out, "value_rollsd_5")[6] is None


def test_nan_counts_as_null(spark):
    out = add_lags_ma(single(spark, [1.0, float("nan"), 3.0]), "date", "value", q=[2])
    assert column(out, "value_ma_2") == [None, 1.0, 3.0]


def test_text_is_not_averaged(spark):
    df = single(spark, [1, 2]).withColumn("value", F.lit("3"))
    with pytest.raises(TypeError):
        add_rolling(df, "date", "value")
    with pytest.raises(TypeError):
        add_lags_ma(df, "date", "value", q=[2])


def test_windows_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    y = [None if rng.random() < 0.2 else float(rng.normal()) for _ in range(60)]
    out = add_rolling(single(spark, y), "date", "value", windows=[4], trend_windows=[6]).orderBy("date").collect()
    for i, r in enumerate(out):
        w = [v for v in y[max(0, i - 3) : i + 1] if v is not None] if i >= 3 else []
        assert r.value_rollsum_4 == (pytest.approx(sum(w)) if w else None)
        assert r.value_rollsd_4 == (pytest.approx(np.std(w, ddof=1)) if len(w) > 1 else None)
        p = [(j, v) for j, v in enumerate(y[max(0, i - 5) : i + 1]) if v is not None] if i >= 5 else []
        assert r.value_rollslope_6 == (pytest.approx(np.polyfit(*zip(*p, strict=True), 1)[0], abs=1e-9) if len(p) > 1 else None)


def test_trend(spark):
    out = add_trend(daily(spark, {"A": range(4), "B": range(3)}), "date", groups=["series"], degrees=[1, 2])
    assert column(out, "trend2", where="series = 'A'") == [1, 4, 9, 16] and dict(out.dtypes)["trend1"] == "int"


def test_calendar(spark):
    df = spark.createDataFrame([(datetime(2023, 1, 1, 8, 15),), (datetime(2024, 2, 29, 23, 45),), (datetime(2021, 1, 3, 14, 30),)], "t timestamp_ntz")
    out = add_calendar(df, "t", woy=True, dom=True, hod=True, moh=True).orderBy("t").collect()
    assert [(r.dow, r.month, r.dom, r.eom, r.woy, r.hod, r.moh) for r in out] == [("7", "01", 3, 0, 53, 14, 30), ("7", "01", 1, 0, 52, 8, 15), ("4", "02", 29, 1, 9, 23, 45)]
    days = spark.createDataFrame([(date(2023, 5, 1),)], "t date")
    with pytest.warns(UserWarning):
        assert add_calendar(days, "t", hod=True).first().hod == 0
    with pytest.warns(UserWarning):
        assert add_calendar(days.withColumn("t", F.lit(3)), "t").columns == ["t"]


def test_holidays(spark):
    df = single(spark, [1, 2, 3])
    h = spark.createDataFrame([(date(2023, 1, 2), "a"), (date(2023, 1, 2), "a"), (None, "b")], "d date, name string")
    out = add_holidays(df, "date", h).orderBy("date").collect()
    assert [(r.holiday, r.name) for r in out] == [(0, None), (1, "a"), (0, None)]


def test_arguments(spark):
    df = single(spark, [1, 2])
    for bad in (dict(p=[0]), dict(q=[0]), dict(xreg_lags={"value": [-1]})):
        with pytest.raises(ValueError):
            add_lags_ma(df, "date", "value", **bad)
    with pytest.raises(ValueError):
        add_rolling(df, "date", "value", stats=["median"])
    with pytest.raises(ValueError):
        add_rolling(df, "date", "value", trend_windows=[1])


def test_one_exchange_for_all_windows(spark):
    out = add_rolling(add_lags_ma(daily(spark, {"A": range(9)}), "date", "value", p=[1, 2], q=[3], groups=["series"]), "date", "value", groups=["series"], windows=[3], trend_windows=[3])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert all(a <= b for a, b in pairwise(column(out, "date")))
