from datetime import date, timedelta

import numpy as np
import pytest
from helpers import column, daily, single

from seriesmill.operators import impute
from seriesmill.operators.impute import borrow, fill_gaps, gap_runs, imputation_summary


def filled(spark, y, strategy, **kw):
    out = fill_gaps(single(spark, y), "value", "date", (), strategy, **kw)
    return column(out, "value"), column(out, "value_is_imputed")


def test_simple_strategies(spark):
    y = [1, None, None, 4, 5]
    assert filled(spark, y, "zero") == ([1, 0, 0, 4, 5], [False, True, True, False, False])
    assert filled(spark, y, "locf")[0] == [1, 1, 1, 4, 5]
    assert filled(spark, y, "nocb")[0] == [1, 4, 4, 4, 5]
    assert filled(spark, y, "linear")[0] == pytest.approx([1, 2, 3, 4, 5])


def test_error_strategy(spark):
    with pytest.raises(ValueError, match="2 missing"):
        filled(spark, [1, None, None], "error")
    assert filled(spark, [1, 2], "error")[1] == [False, False]
    with pytest.raises(ValueError):
        filled(spark, [1], "guess")


def test_edges(spark):
    with pytest.raises(ValueError, match="starts"):
        filled(spark, [None, 1, 2], "locf")
    with pytest.raises(ValueError, match="ends"):
        filled(spark, [1, 2, None], "nocb")
    with pytest.raises(ValueError):
        filled(spark, [None, 1, 2], "linear")
    with pytest.raises(ValueError):
        filled(spark, [1, None], "linear", extrapolate=True)
    assert filled(spark, [None, 1, None, 3, None], "linear", extrapolate=True)[0] == pytest.approx([1, 1, 2, 3, 3])
    whole = daily(spark, {"A": [None, 1], "B": [1, 2]})
    with pytest.raises(ValueError):
        fill_gaps(whole, "value", "date", ["series"], "locf")


def test_linear_is_weighted_by_time(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 0.0), (date(2024, 1, 2), None), (date(2024, 1, 5), 8.0)], "date date, value double")
    assert column(fill_gaps(df, "value", "date", (), "linear"), "value") == pytest.approx([0, 2, 8])


@pytest.mark.parametrize("strategy", ["locf", "nocb", "linear", "rolling_mean"])
def test_max_gap(spark, strategy):
    y = [1, None, None, 4, None, 6]
    filled(spark, y, strategy, max_gap=2)
    with pytest.raises(ValueError, match="longer"):
        filled(spark, y, strategy, max_gap=1)


def test_rolling_mean(spark):
    y = [1, 2, None, 4, 5, None, None, None, None, 9]
    assert filled(spark, y, "rolling_mean", window=3)[0] == [1, 2, 3, 4, 5, 5, None, None, 9, 9]
    assert filled(spark, y, "rolling_mean", window=3, center=False)[0][2] == 1.5


def test_gap_runs(spark):
    rows = gap_runs(daily(spark, {"A": [1, None, None, 4, None], "B": [1, 2]}), "value", "date", ["series"]).orderBy("first").collect()
    assert [(r.series, r["length"]) for r in rows] == [("A", 2), ("A", 1)]


def stores(spark, gaps=(2, 3)):
    a, b, c = ([base + 10 * i for i in range(20)] for base in (10, 12, 8))
    for i in gaps:
        a[i] = None
    return daily(spark, {"A": a, "B": b, "C": c}, schema="store string, date date, sales double")


def test_borrow(spark):
    out = fill_gaps(stores(spark), "sales", "date", ["store"], "borrow")
    assert column(out, "sales", where="store = 'A'")[2:4] == [30, 40]
    assert out.where("sales_is_imputed").count() == 2
    out = fill_gaps(stores(spark, (4, 5)), "sales", "date", ["store"], "borrow", method="mean")
    assert column(out, "sales", where="store = 'A'")[4:6] == [50, 60]


def test_borrow_without_a_peer_stays_missing(spark):
    out = fill_gaps(daily(spark, {"A": [1, None], "B": [1, None]}), "value", "date", ["series"], "borrow")
    assert out.where("value is null").count() == 2 and out.where("value_is_imputed").count() == 0


def test_borrow_weighted(spark):
    df = daily(spark, {"A": [10, 10, None], "B": [11, 11, 20], "C": [13, 13, 40]})
    out = fill_gaps(df, "value", "date", ["series"], "borrow", method="weighted")
    assert column(out, "value", where="series = 'A'")[2] == pytest.approx(0.75 * 20 + 0.25 * 40, abs=1e-3)
    far = daily(spark, {"A": [None, None, 5], "B": [4, None, None], "C": [8, None, None]})
    assert column(fill_gaps(far, "value", "date", ["series"], "borrow", method="weighted"), "value", where="series = 'A'")[0] == pytest.approx(6)


def test_borrow_neighbours(spark):
    df = daily(spark, {"A": [10, None], "B": [20, 30], "C": [40, 50]})
    get = lambda n: column(fill_gaps(df, "value", "date", ["series"], "borrow", neighbors=n), "value", where="series = 'A'")[1]
    assert get(["B"]) == 30 and get({"A": ["C"]}) == 50 and get({"B": ["C"]}) is None
    with pytest.raises(ValueError):
        fill_gaps(df, "value", "date", (), "borrow")


def test_stl(spark):
    rng = np.random.default_rng(1)
    y = [50 + 10 * np.sin(2 * np.pi * t / 7) + rng.normal() for t in range(100)]
    gappy = [None if i in (20, 21, 50, 51, 52) else v for i, v in enumerate(y)]
    got, flags = filled(spark, gappy, "stl")
    assert sum(flags) == 5 and max(abs(a - b) for a, b in zip(got, y, strict=True)) < 6
    with pytest.raises(Exception, match="STL needs"):
        filled(spark, [1, None] + [2] * 8, "stl", period=7)


def test_stl_months(spark):
    rows = [(date(2015 + i // 12, i % 12 + 1, 1), None if i == 30 else 10 + 5 * np.sin(2 * np.pi * i / 12) + 0.1 * i) for i in range(60)]
    df = spark.createDataFrame([(d, None if v is None else float(v)) for d, v in rows], "date date, value double")
    assert column(fill_gaps(df, "value", "date", (), "stl"), "value")[30] == pytest.approx(10 + 5 * np.sin(np.pi * 5) + 3, abs=1)


def test_custom(spark):
    got, flags = filled(spark, [1, None, 3], "custom", fn=lambda y, d, p: (np.where(np.isnan(y), p["v"], y), np.isnan(y)), params={"v": 9.0})
    assert got == [1, 9, 3] and flags == [False, True, False]
    with pytest.raises(Exception, match="a value and a flag"):
        filled(spark, [1, None], "custom", fn=lambda y, d, p: (y[:1], [True]))


def test_summary_and_nan(spark):
    out = fill_gaps(single(spark, [1.0, float("nan"), 3.0]), "value", "date", (), "zero")
    assert imputation_summary(out, "value").first() == (1, 3, pytest.approx(100 / 3))
    assert imputation_summary(fill_gaps(single(spark, []), "value", "date", (), "zero"), "value").first()[2] == 0


@pytest.mark.parametrize("how", [dict(method="median"), dict(method="weighted"), dict(method="weighted", neighbors={"A": ["B", "C"]}), dict(neighbors=["B"])])
def test_borrow_plans_have_no_nested_loops(spark, how):
    """No join without keys, whether or not small sides are broadcast."""
    df = daily(spark, {"A": [1, None, 3], "B": [2, 3, 4], "C": [5, None, 9]})
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in (old, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        plan = borrow(df, "value", "date", ["series"], **how)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_long_series_are_filled_in_one_pass(spark):
    """No frame that shrinks: those are read again for each row."""
    df = single(spark, [None if i % 7 else i for i in range(1, 30_000)] + [5])
    for strategy in ("nocb", "linear"):
        out = fill_gaps(df, "value", "date", strategy=strategy, extrapolate=True)
        assert "unboundedfollowing$()" not in out._jdf.queryExecution().executedPlan().toString().lower().replace(" ", "")
        assert out.where("value is null").count() == 0


def lent_by_hand(series, eps=1e-6):
    """{(name, day): value} by plain loops over {name: [(day, value or None)]}; days may repeat."""
    out = {}
    for g, points in series.items():
        has = {q: [abs(y - z) for d, y in points for e, z in other if d == e and None not in (y, z)] for q, other in series.items() if q != g}
        far = {q: np.mean(v) for q, v in has.items() if v}
        for day in {d for d, y in points if y is None}:
            at = [(1 / (far.get(q, 10 * max(far.values(), default=0.1)) + eps), z) for q in has for e, z in series[q] if e == day and z is not None]
            if at:
                out[g, day] = sum(w * z for w, z in at) / sum(w for w, _ in at)
    return out


@pytest.mark.parametrize("block", [250_000, 300])
def test_borrow_weighted_by_hand(spark, monkeypatch, block):
    """Sparse and full series, dates that occur twice, series without a shared date, null names, one group or two, in one block and in many."""
    monkeypatch.setattr(impute, "BLOCK", block)
    rng = np.random.default_rng(3)
    series = {}
    for i in range(60):
        days = [d for d in range(40) if rng.random() < (0.9, 0.1, 0.5)[i % 3] and (i % 10 or d < 5)]
        series[f"s{i}" if i else None, i % 2] = [(d, None if rng.random() < 0.15 else round(float(rng.normal(50, 20)), 2)) for d in days + days[:1] * (i % 7 == 0)]
    series["late", 0], series["later", 1] = [(90, 1.0), (91, None), (5, None)], [(91, 4.0), (92, None)]
    rows = [(*k, date(2023, 1, 1) + timedelta(days=d), y) for k, points in series.items() for d, y in points]
    df = spark.createDataFrame(rows, "series string, part int, date date, value double")
    got = borrow(df, "value", "date", ["series", "part"], method="weighted").collect()
    want = lent_by_hand(series)
    assert len(got) == len(want) > 80
    for s, part, day, value in got:
        assert value == pytest.approx(want[(s, part), (day - date(2023, 1, 1)).days], rel=1e-9)


def test_borrow_weighted_infinite_values_stay_where_they_are(spark):
    inf = float("inf")
    df = daily(spark, {"A": [1, inf, None, None], "B": [2, inf, 7, None], "C": [4, 5, 9, 8], "D": [1, 2, None, None], "E": [3, 4, None, 3]})
    lent = {(r[0], r[1].day): r[2] for r in borrow(df, "value", "date", ["series"], method="weighted").collect()}
    assert set(lent) == {("A", 3), ("D", 3), ("D", 4), ("E", 3)}  # all lenders of A and B on the fourth are infinitely far
    assert np.isnan(lent["A", 3]) and lent["D", 3] == lent["E", 3] == pytest.approx(9) and lent["D", 4] == pytest.approx(5, abs=1e-4)
    far = daily(spark, {"A": [1, None, None], "B": [None, inf, 7], "C": [3, 2, 9]})
    lent = {(r[0], r[1].day): r[2] for r in borrow(far, "value", "date", ["series"], method="weighted").collect()}
    assert lent["A", 2] == inf and lent["A", 3] == pytest.approx((9 / 2 + 7 / 20) / (1 / 2 + 1 / 20), abs=1e-4)


def test_borrow_weighted_makes_no_row_for_each_pair_and_date(spark):
    df = daily(spark, {"A": [1, None, 3], "B": [2, 3, 4], "C": [5, None, 9]})
    plan = borrow(df, "value", "date", ["series"], method="weighted")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan


def test_borrow_weighted_without_lenders(spark):
    df = daily(spark, {"A": [None, None], "B": [None, None]})
    assert borrow(df, "value", "date", ["series"], method="weighted").count() == 0
    assert borrow(df.where("false"), "value", "date", ["series"], method="weighted").count() == 0
    lent = borrow(daily(spark, {"A": [1, None], "B": [1, 7], "C": [5, 9]}), "value", "date", ["series"], method="weighted", neighbors=["C"]).collect()
    assert [r[2] for r in lent] == [9]
