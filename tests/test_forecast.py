from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import column, daily, single
from pyspark.sql import functions as F

from seriesmill.operators.forecasting import _window_value, fit, tail_value, train_matrix
from seriesmill.operators.models import Ensemble, MLModel, PandasModel, solve_gram


def noise(n, seed=0):
    return np.random.default_rng(seed).normal(10, 2, n).tolist()


@pytest.mark.parametrize("n,f,rows", [(30, "p(1:10)", 20), (101, "p(2) + rollsum(10)", 92), (21, "p(1) + q(7)", 15), (51, "p(5)", 46), (51, "rollsum(10) + trend(1)", 42)])
def test_training_rows(spark, n, f, rows):
    assert train_matrix(single(spark, noise(n)), f"value ~ {f}", "date").count() == rows


def test_dates_follow_the_history(spark):
    df = single(spark, noise(100), date(2020, 1, 1))
    out = fit("value ~ p(3)", df, date="date").forecast(5)
    assert column(out, "date") == [date(2020, 4, 10) + timedelta(days=i) for i in range(5)]
    assert out.columns == ["date", "value_forecast"]
    assert column(fit("value ~ p(3)", df, date="date").forecast(5, return_index=True), "step", "step") == [1, 2, 3, 4, 5]


def test_groups(spark):
    df = daily(spark, {s: noise(100, i) for i, s in enumerate("ABC")})
    out = fit("value ~ p(2) + trend(1)", df, date="date", groups=["series"]).forecast(5)
    assert sorted(r["count"] for r in out.groupBy("series").count().collect()) == [5, 5, 5]


def weekly(n=400):
    rng = np.random.default_rng(5)
    return [20 + 5 * np.sin(2 * np.pi * i / 7) + 0.02 * i + rng.normal() for i in range(n)]


@pytest.mark.parametrize("f", ["p(c(1, 7)) + q(7, 14) + trend(1) + dow() + month()", "p(3)", "rollsum(5) + rollsd(5) + rollmin(4) + rollmax(4) + rollslope(6) + trend(1, 2)", "trend(2) + dow() + eom()", "q(7)"])
def test_native_and_pandas_agree(spark, f):
    m = fit(f"value ~ {f}", daily(spark, {"A": weekly(), "B": weekly(300)}), date="date", groups=["series"], frequency="day")
    a = m.forecast(14, engine="native").orderBy("series", "date").toPandas()
    b = m.forecast(14, engine="pandas").orderBy("series", "date").toPandas()
    assert len(a) == 28 and np.allclose(a["value_forecast"], b["value_forecast"], atol=1e-10, rtol=0)


def test_recursion_by_hand(spark):
    m = fit("value ~ p(2)", single(spark, noise(50)), date="date")
    m.model.intercept, m.model.coef = 1.0, {"value_lag_1": 0.5, "value_lag_2": 0.25}
    m.history = single(spark, [10, 20, 30])
    want, y = [], [10, 20, 30]
    for _ in range(4):
        y.append(1 + 0.5 * y[-1] + 0.25 * y[-2])
        want.append(y[-1])
    assert column(m.forecast(4), "value_forecast") == pytest.approx(want)


def test_ols_recovers_coefficients(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    rows = [(date(2020, 1, 1) + timedelta(days=i), float(3 + 2 * x[i] + rng.normal(0, 0.01)), float(x[i]), float(2 * x[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "date date, value double, x double, twice double")
    m = fit("value ~ x + twice", df, date="date").model
    assert m.intercept == pytest.approx(3, abs=0.01) and m.coef == {"x": pytest.approx(2, abs=0.01)}


def test_gram_drops_aliased_columns_in_order():
    x = np.random.default_rng(0).normal(size=(50, 2))
    a = np.column_stack([x[:, 0], x[:, 0] * 3, x[:, 1], x.sum(axis=1)])
    a -= a.mean(axis=0)
    got = solve_gram(a.T @ a, a.T @ (a[:, 0] + 2 * a[:, 2]), 1e-10)
    assert got[1] is None and got[3] is None and got[0] == pytest.approx(1) and got[2] == pytest.approx(2)


def test_unseen_level_gives_no_forecast(spark):
    m = fit("value ~ month()", single(spark, noise(40), date(2024, 1, 1)), date="date", frequency="day")
    got = m.forecast(30).orderBy("date").collect()
    assert got[0].value_forecast is not None and got[-1].date == date(2024, 3, 10) and got[-1].value_forecast is None


def test_hourly(spark):
    rows = [(datetime(2024, 1, 1) + timedelta(hours=i), float(i % 24)) for i in range(168)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, value double")
    out = fit("value ~ p(1) + hod()", df, date="datetime", frequency="hour").forecast(24)
    assert out.count() == 24 and dict(out.dtypes)["datetime"] == "timestamp_ntz"


def test_errors(spark):
    df = single(spark, noise(30))
    with pytest.raises(ValueError, match="trailing NA"):
        fit("value ~ p(1)", single(spark, [*noise(20), None]), date="date").forecast(2)
    with pytest.raises(ValueError, match="no training rows"):
        fit("value ~ p(40)", df, date="date")
    with pytest.raises(TypeError):
        fit("value ~ p(1)", df.withColumn("date", F.lit(1)), date="date")
    with pytest.raises(ValueError):
        fit("value ~ p(1)", df)
    m = fit("value ~ p(1)", df, date="date")
    for bad in (dict(), dict(h=0), dict(h=1, engine="c++"), dict(h=1, xreg_strategy="guess")):
        with pytest.raises(ValueError):
            m.forecast(**bad)


def priced(spark, n=100):
    rng = np.random.default_rng(8)
    rows = [(date(2024, 1, 1) + timedelta(days=i), float(rng.normal(10)), float(5 + i % 4), None if i == n - 1 else float(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "date date, value double, price double, promo double")


@pytest.mark.parametrize("f", ["p(1) + lag(price, 1, 2)", "p(2) + ma(price, 7)", "p(1) + price", "price"])
def test_future_values(spark, f):
    df = priced(spark)
    future = spark.createDataFrame([(date(2024, 4, 10) + timedelta(days=i), 6.0) for i in range(5)], "date date, price double")
    m = fit(f"value ~ {f}", df, date="date")
    a, b = (m.forecast(future=future, engine=e).orderBy("date").toPandas() for e in ("native", "pandas"))
    assert len(a) == 5 and a["value_forecast"].notna().all() and np.allclose(a["value_forecast"], b["value_forecast"], atol=1e-10)


def test_xreg_strategies(spark):
    m = fit("value ~ price + promo", priced(spark), date="date", frequency="day")
    c = m.model
    carry = column(m.forecast(2), "value_forecast")
    assert carry == pytest.approx([c.intercept + 8 * c.coef["price"] + 0 * c.coef["promo"]] * 2)  # the last promo that is there
    assert column(m.forecast(2, xreg_strategy="zeros"), "value_forecast") == pytest.approx([c.intercept] * 2)
    assert column(m.forecast(2, xreg_strategy="NA"), "value_forecast") == [None, None]
    with pytest.raises(ValueError, match="no future values"):
        m.forecast(2, xreg_strategy="error")


def test_future_is_checked(spark):
    m = fit("value ~ price", priced(spark), date="date")
    rows = [(date(2024, 4, 10), 1.0), (date(2024, 4, 10), 1.0)]
    with pytest.raises(ValueError, match="twice"):
        m.forecast(future=spark.createDataFrame(rows, "date date, price double"))
    with pytest.raises(ValueError, match="h is 3"):
        m.forecast(3, future=spark.createDataFrame(rows[:1], "date date, price double"))
    with pytest.raises(ValueError, match="no column"):
        m.forecast(future=spark.createDataFrame([(1.0,)], "price double"))
    with pytest.raises(ValueError, match="no rows"):
        m.forecast(future=spark.createDataFrame([], "date date, price double"))


def lstsq():
    def f(y, x):
        a = np.column_stack([np.ones(len(x)), pd.get_dummies(x, drop_first=True, dtype=float).to_numpy(float)])
        return np.linalg.lstsq(a, y, rcond=None)[0]

    return PandasModel(f, lambda b, x: b[0] + pd.get_dummies(x, drop_first=True, dtype=float).to_numpy(float) @ b[1:])


def test_custom_model_matches_ols(spark):
    df = daily(spark, {"A": weekly(120)})
    kw = dict(date="date", groups=["series"], frequency="day")
    a = column(fit("value ~ p(2) + dow()", df, **kw).forecast(7), "value_forecast")
    assert column(fit("value ~ p(2) + dow()", df, lstsq(), **kw).forecast(7), "value_forecast") == pytest.approx(a, abs=1e-8)
    both = Ensemble.inverse_error([lstsq(), lstsq()], [1.0, 3.0])
    assert column(fit("value ~ p(2) + dow()", df, both, **kw).forecast(7), "value_forecast") == pytest.approx(a, abs=1e-8)


def test_failing_model(spark):
    def boom(b, x):
        raise RuntimeError("boom")

    m = fit("value ~ p(1)", single(spark, noise(30)), PandasModel(lambda y, x: 0, boom), date="date")
    with pytest.raises(Exception, match="boom"):
        m.forecast(2).collect()
    assert column(m.forecast(2, on_error="null"), "value_forecast") == [None, None]


@pytest.mark.parametrize("name", ["GeneralizedLinearRegression", "RandomForestRegressor", "GBTRegressor", "DecisionTreeRegressor"])
def test_mllib(spark, name):
    import pyspark.ml.regression as r

    df = daily(spark, {"A": weekly(120)})
    m = fit("value ~ p(2) + dow()", df, MLModel(getattr(r, name)()), date="date", groups=["series"], frequency="day")
    got = column(m.forecast(5), "value_forecast")
    assert len(got) == 5 and all(0 < v < 50 for v in got)
    if name.startswith("Gen"):
        assert got == pytest.approx(column(fit("value ~ p(2) + dow()", df, date="date", groups=["series"], frequency="day").forecast(5), "value_forecast"), abs=1e-6)


@pytest.mark.parametrize("kind", ["ma", "rollsum", "rollsd", "rollmin", "rollmax", "rollslope"])
def test_tail_features(spark, kind):
    for tail in ([1.0, 4.0, 9.0, 16.0, 2.0], [None, None, 10.0], [10.0, 20.0, 30.0], [None, 10.0, 20.0], [None, None, None]):
        for n in (3, 5):
            df = spark.createDataFrame([(tail,)], "t array<double>")
            got = df.select(_window_value(kind, F.col("t"), n)).first()[0]
            want = tail_value(kind, [np.nan if v is None else v for v in tail], n)
            assert (got is None and np.isnan(want)) or got == pytest.approx(want)


def test_leak_free_windows(spark):
    df = single(spark, [1, 2, 3, 4, 5, 6, 7, 9])
    a = train_matrix(df, "value ~ q(2)", "date", window_lag=1).orderBy("date").first()
    assert a.value == 3 and a.value_ma_2 == 1.5


def test_carry_and_unseen_values_are_named(spark):
    rows = [("A" if i % 2 else "B", date(2023, 1, 1) + timedelta(days=i // 2), float(i), None if i > 55 else float(i % 5), "u" if i % 3 else "v", None if i % 2 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "series string, date date, value double, x double, k string, gone double")
    kw = dict(date="date", groups=["series"], frequency="day")
    with pytest.warns(UserWarning, match="ends with a missing value"):
        fit("value ~ trend(1) + x", df, **kw).forecast(2)
    with pytest.warns(UserWarning, match="has no values in 1 series"):
        fit("value ~ gone", df, **kw).forecast(2)
    future = spark.createDataFrame([(s, date(2023, 2, 1), "new") for s in "AB"], "series string, date date, k string")
    with pytest.warns(UserWarning, match="not seen in training"):
        assert fit("value ~ k", df, **kw).forecast(future=future).where("value_forecast is null").count() == 2
