from datetime import date

import numpy as np
import pytest
from helpers import daily, single

from seriesmill.operators.models import OLS, PandasModel
from seriesmill.operators.validation import accuracy_by_group, accuracy_by_step, alignment, compare_models, cv_forecast, fold_metrics, folds, grid_search


def noise(n, seed=0):
    return np.random.default_rng(seed).normal(10, 2, n).tolist()


def test_folds():
    f = folds(30, 3, 4)
    assert [(x.train_start, x.train_end, x.test_start, x.test_end) for x in f] == [(1, 18, 19, 21), (1, 21, 22, 24), (1, 24, 25, 27), (1, 27, 28, 30)]
    s = folds(30, 3, 2, "sliding", 12)
    assert [(x.train_start, x.train_end) for x in s] == [(13, 24), (16, 27)]
    assert [x.test_end for x in folds(100, 5, 3, step_size=2)] == [96, 98, 100]  # the start depends on h, the last windows stay
    assert folds(12, 3, 2) == [] or all(x.train_end >= 10 for x in folds(12, 3, 2))
    for bad in (dict(h=0), dict(n_windows=0), dict(step_size=-1), dict(window_type="odd"), dict(window_type="sliding")):
        with pytest.raises(ValueError):
            folds(**{"n": 50, "h": 2, "n_windows": 3} | bad)


def test_cv(spark):
    out = cv_forecast("value ~ p(2)", single(spark, noise(200)), date="date", h=5, n_windows=3, return_predictions=True)
    rows = out.metrics.orderBy("fold").collect()
    assert [r.fold for r in rows] == [0, 1, 2, 3] and rows[0].rmse is not None
    assert {"actual", "predicted", "fold", "date"} <= set(out.predictions.columns) and out.predictions.count() == 15
    squares = [(r.rmse**2, r.n_test) for r in rows[1:]]
    assert rows[0].rmse == pytest.approx(np.sqrt(sum(a * n for a, n in squares) / sum(n for _, n in squares)))
    s = out.summary().first()
    assert s["min"] <= s["median"] <= s["max"]


def test_grouped_sliding_and_metrics(spark):
    df = daily(spark, {"A": noise(150), "B": noise(150, 1)})
    kw = dict(date="date", groups=["series"], h=7, n_windows=2)
    out = cv_forecast("value ~ p(1) + trend(1)", df, window_type="sliding", window_size=50, metric="mae", return_predictions=True, **kw)
    assert out.metrics.where("fold > 0").count() == 2
    assert accuracy_by_step(out.predictions, "date", ["series"]).count() == 7 and accuracy_by_group(out.predictions, ["series"]).count() == 2
    custom = cv_forecast("value ~ p(1)", df, metric=lambda a, p: np.max(np.abs(a - p)), **kw)
    assert custom.metrics.count() == 3
    assert compare_models("value ~ p(1)", df, {"a": OLS(), "b": OLS()}, **kw).count() == 2
    assert grid_search(["value ~ p(1)", "value ~ p(2)"], df, **kw).count() == 2


def test_metrics_by_hand(spark):
    p = spark.createDataFrame([(1, 10.0, 8.0), (1, 0.0, 1.0), (2, 5.0, 5.0), (2, None, 3.0)], "fold int, actual double, predicted double")
    got = {(r.fold): r for r in fold_metrics(p, "mape").collect()}
    assert got[1].mape == pytest.approx(20) and got[2].mape == 0
    zero = spark.createDataFrame([(1, 0.0, 8.0)], "fold int, actual double, predicted double")
    assert fold_metrics(zero, "mape").where("fold = 1").first().mape is None
    mse = {r.fold: r.mse for r in fold_metrics(p, "mse").collect()}
    assert mse[1] == pytest.approx(2.5)


def test_alignment(spark):
    a = daily(spark, {"A": noise(60), "B": noise(60)})
    assert alignment(a, "date", ["series"]).first() == (2, 1)
    cv_forecast("value ~ p(1)", a.orderBy("value"), date="date", groups=["series"], h=3, n_windows=2)
    shifted = daily(spark, {"A": noise(60)}).unionByName(daily(spark, {"B": noise(60)}, date(2023, 1, 2)))
    with pytest.raises(ValueError, match="identical date sequences"):
        cv_forecast("value ~ p(1)", shifted, date="date", groups=["series"], h=3)


def test_failures(spark):
    df = single(spark, noise(40))
    with pytest.raises(ValueError):
        cv_forecast("value ~ p(1)", df, date="date", metric="r2")
    with pytest.raises(ValueError, match="too few"):
        cv_forecast("value ~ p(1)", single(spark, noise(8)), date="date", h=3)
    with pytest.warns(UserWarning, match="left out"), pytest.raises(ValueError, match="every fold"):
        cv_forecast("value ~ p(38)", df, date="date", h=2, n_windows=2)


def test_monthly_lags_keep_their_dates(spark):
    rows = [(date(2015 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(noise(60))]
    out = cv_forecast("value ~ p(1)", spark.createDataFrame(rows, "date date, value double"), date="date", h=4, n_windows=2, return_predictions=True)
    assert out.predictions.count() == 8


def test_a_fold_that_fails_in_a_task_is_left_out(spark):
    df = single(spark, noise(60))

    def predict(rows, x):
        if rows < 56:
            raise RuntimeError("on purpose")
        return np.zeros(len(x))

    with pytest.warns(UserWarning, match="fold 1 is left out"):
        out = cv_forecast("value ~ p(1)", df, PandasModel(lambda y, x: len(y), predict), date="date", h=2, n_windows=2)
    assert sorted(r.fold for r in out.metrics.collect()) == [0, 2]


def test_zero_actuals_are_named(spark):
    with pytest.warns(UserWarning, match="zero"):
        cv_forecast("value ~ trend(1)", single(spark, [*noise(40), 0.0, 3.0]), date="date", h=2, n_windows=1, metric="mape")
