from datetime import date, timedelta

import numpy as np
import pytest
from helpers import column, daily

from seriesmill.operators.features import build_features
from seriesmill.operators.forecasting import fit
from seriesmill.plans.formula import parse
from seriesmill.sources.panels import retail
from seriesmill.sources.store import load_fit, read_panel, save_fit, write_table
from seriesmill.streaming.live_features import live_features


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "orc"])
def test_round_trip(spark, tmp_path, kind):
    df = daily(spark, {"A": [1, 2, None], "B": [4, 5]})
    write_table(df, str(tmp_path / "t"), kind)
    back = read_panel(spark, str(tmp_path / "t"), "date", kind)
    assert sorted(map(tuple, back.select(df.columns).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "x"), "xls")


def test_saved_fit_forecasts_the_same(spark, tmp_path):
    f = fit("value ~ p(2) + dow()", daily(spark, {"A": np.random.default_rng(0).normal(size=40).tolist()}), date="date", groups=["series"], frequency="day")
    save_fit(f, str(tmp_path / "fit"))
    g = load_fit(spark, str(tmp_path / "fit"))
    assert column(g.forecast(5), "value_forecast") == column(f.forecast(5), "value_forecast") and repr(f) == repr(g)


def test_retail(spark):
    df = retail(spark)
    assert df.count() == 13986 and df.select("items").distinct().count() == 42


def test_short_history_warns(spark):
    df = daily(spark, {"A": range(30), "B": [1, 2]})
    with pytest.warns(UserWarning, match="looks back"):
        fit("value ~ p(5)", df, date="date", groups=["series"], frequency="day").forecast(2)


def test_live_features_match_the_table(spark, tmp_path):
    rng = np.random.default_rng(1)
    whole = {s: [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=30)] for s in "AB"}
    for i in range(3):  # three files, three micro-batches
        part = {s: v[10 * i : 10 * i + 10] for s, v in whole.items()}
        daily(spark, part, date(2023, 1, 1) + timedelta(days=10 * i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    formula = "value ~ p(c(1, 3)) + q(4) + rollsd(5) + rollslope(4)"
    stream = spark.readStream.schema("series string, date date, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live_features(stream, formula, "date", ["series"]).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    df = daily(spark, whole)
    spec = parse(formula, df.columns)
    want = build_features(df, spec, "date", ["series"]).orderBy("series", "date").select("series", "date", *spec.columns).toPandas()
    got = spark.table("live").orderBy("series", "date").select("series", "date", *spec.columns).toPandas()
    assert len(got) == 60
    assert np.allclose(got[spec.columns].astype(float), want[spec.columns].astype(float), equal_nan=True)
    with pytest.raises(ValueError):
        live_features(stream, "value ~ trend()", "date", ["series"])
