"""Registered queries of the time-series engine and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from ..operators import features, forecasting, impute, models, panel, validation
from ..sources import panels

P1 = "p1 AS (SELECT l_returnflag AS series, l_shipdate::DATE AS date, sum(l_quantity) AS y, count(*) AS x FROM lineitem GROUP BY 1, 2)"
P1M = P1 + ", p AS (SELECT series, date, CASE WHEN date_diff('day', DATE '1995-01-01', date) % 11 <> 0 THEN y END AS y, x FROM p1)"
P2 = "p2 AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS date, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2)"
P2A = P2.replace("p2 AS", "p2raw AS", 1) + ", p2 AS (SELECT * FROM p2raw WHERE date IN (SELECT date FROM p2raw GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT series) FROM p2raw)))"
P3 = "p3 AS (SELECT event_type AS series, date_trunc('hour', ts)::TIMESTAMP AS date, round(sum(value), 2) AS y FROM events GROUP BY 1, 2)"
P4 = "p4 AS (SELECT user_id AS series, ts::DATE AS date, round(sum(value), 2) AS y FROM events GROUP BY 1, 2)"
P4M = P4 + ", p AS (SELECT series, date, CASE WHEN (date_diff('day', DATE '1995-01-01', date) + series) % 11 <> 0 THEN y END AS y FROM p4)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def p1m(spark: SparkSession, d: str) -> DataFrame:
    return panels.masked(panels.daily_shipments(spark, d))


def p4m(spark: SparkSession, d: str) -> DataFrame:
    p = panels.user_days(spark, d)
    days = F.call_function("datediff", F.col("date"), F.lit("1995-01-01").cast("date"))
    return p.withColumn("y", F.when(F.pmod(days + F.col("series"), F.lit(11)) != 0, F.col("y")))


def aligned_orders(spark: SparkSession, d: str) -> DataFrame:
    """P2 at the months that all series have: cross-validation needs the same dates everywhere."""
    p = panels.monthly_orders(spark, d)
    n = p.agg(F.count_distinct("series")).first()[0]
    return p.join(p.groupBy("date").count().where(F.col("count") == n).select("date"), "date").select("series", "date", "y")


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


# ---------------------------------------------------------------- features

LAGS = (1, 2, 3, 7)


@query(f"WITH {P1M} SELECT series, date, " + ", ".join(f"lag(y, {n}) OVER w AS y_lag_{n}" for n in LAGS) + " FROM p WINDOW w AS (PARTITION BY series ORDER BY date)")
def lag_set(spark, d):
    return features.add_lags_ma(p1m(spark, d), "date", "y", p=LAGS, groups=["series"]).select("series", "date", *[f"y_lag_{n}" for n in LAGS])


def _rolled(agg: str, name: str, n: int) -> str:
    frame = f"(PARTITION BY series ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count(*) OVER {frame} = {n} THEN {agg}(y) OVER {frame} END, 6) AS y_{name}_{n}"


@query(f"WITH {P1M} SELECT series, date, {_rolled('avg', 'ma', 7)}, {_rolled('avg', 'ma', 28)} FROM p")
def ma_full_window(spark, d):
    return rounded(features.add_lags_ma(p1m(spark, d), "date", "y", q=(7, 28), groups=["series"]).select("series", "date", "y_ma_7", "y_ma_28"), "y_ma_7", "y_ma_28")


def _roll_query(stat: str, agg: str):
    def run(spark, d):
        out = features.add_rolling(p1m(spark, d), "date", "y", groups=["series"], windows=(7, 28), stats=(stat,))
        cols = [f"y_roll{stat}_7", f"y_roll{stat}_28"]
        return rounded(out.select("series", "date", *cols), *cols)

    run.__name__ = f"roll_{stat}"
    query(f"WITH {P1M} SELECT series, date, {_rolled(agg, f'roll{stat}', 7)}, {_rolled(agg, f'roll{stat}', 28)} FROM p")(run)


for _stat, _agg in (("sum", "sum"), ("sd", "stddev_samp"), ("min", "min"), ("max", "max")):
    _roll_query(_stat, _agg)


@query(f"""WITH {P1M}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS rn FROM p),
s AS (SELECT series, date, count(*) OVER w AS n, regr_slope(y, rn) OVER w AS b FROM r WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT series, date, CASE WHEN n = 7 AND NOT isnan(b) THEN round(b, 6) END AS y_rollslope_7 FROM s""")
def roll_slope(spark, d):
    out = features.add_rolling(p1m(spark, d), "date", "y", groups=["series"], windows=(7,), stats=(), trend_windows=(7,))
    return rounded(out.select("series", "date", "y_rollslope_7"), "y_rollslope_7")


@query(f"WITH {P1M} SELECT series, date, x, lag(x, 1) OVER w AS x_lag_1, lag(x, 7) OVER w AS x_lag_7 FROM p WINDOW w AS (PARTITION BY series ORDER BY date)")
def xreg_lag(spark, d):
    return features.add_lags_ma(p1m(spark, d), "date", "y", groups=["series"], xreg_lags={"x": [0, 1, 7]}).select("series", "date", "x", "x_lag_1", "x_lag_7")


@query(f"""WITH {P1M} SELECT series, date, round(CASE WHEN count(*) OVER w = 7 THEN avg(x) OVER w END, 6) AS x_ma_7 FROM p
WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def xreg_ma(spark, d):
    return rounded(features.add_lags_ma(p1m(spark, d), "date", "y", groups=["series"], xreg_ma={"x": [7]}).select("series", "date", "x_ma_7"), "x_ma_7")


@query(f"WITH {P1}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS rn FROM p1) SELECT series, date, rn::INT AS trend1, (rn * rn)::DOUBLE AS trend2, (rn * rn * rn)::DOUBLE AS trend3 FROM r")
def trend_poly(spark, d):
    return features.add_trend(panels.daily_shipments(spark, d), "date", groups=["series"], degrees=(1, 2, 3)).select("series", "date", "trend1", "trend2", "trend3")


@query(f"""WITH {P1} SELECT series, date, isodow(date)::VARCHAR AS dow, strftime(date, '%m') AS month, day(date)::INT AS dom, (date = last_day(date))::INT AS eom, weekofyear(date)::INT AS woy FROM p1""")
def calendar_daily(spark, d):
    out = features.add_calendar(panels.daily_shipments(spark, d), "date", woy=True, dom=True)
    return out.select("series", "date", "dow", "month", "dom", "eom", "woy")


@query(f"""WITH {P3} SELECT series, date, isodow(date)::VARCHAR AS dow, hour(date)::INT AS hod, minute(date)::INT AS moh, (date::DATE = last_day(date::DATE))::INT AS eom FROM p3""")
def calendar_hourly(spark, d):
    out = features.add_calendar(panels.hourly_events(spark, d), "date", month=False, hod=True, moh=True)
    return out.select("series", "date", "dow", "hod", "moh", "eom")


HOLIDAYS = [("1996-01-01", "new year"), ("1996-12-25", "christmas"), ("1996-12-25", "christmas"), ("1997-07-04", "independence")]


@query(f"""WITH {P1}, h(day, name) AS (VALUES (DATE '1996-01-01', 'new year'), (DATE '1996-12-25', 'christmas'), (DATE '1997-07-04', 'independence'))
SELECT series, date, name, (day IS NOT NULL)::INT AS holiday FROM p1 LEFT JOIN h ON date = day""")
def holiday_flag(spark, d):
    h = spark.createDataFrame(HOLIDAYS, "day string, name string").withColumn("day", F.col("day").cast("date"))
    return features.add_holidays(panels.daily_shipments(spark, d), "date", h).select("series", "date", "name", "holiday")


@query(f"""WITH {P1M}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS rn FROM p),
f AS (SELECT series, date, y, lag(y, 1) OVER w AS y_lag_1, lag(y, 2) OVER w AS y_lag_2, lag(y, 3) OVER w AS y_lag_3, {_rolled('avg', 'ma', 7)}, rn::INT AS trend1, isodow(date)::VARCHAR AS dow
FROM r WINDOW w AS (PARTITION BY series ORDER BY date))
SELECT * FROM f WHERE y IS NOT NULL AND y_lag_1 IS NOT NULL AND y_lag_2 IS NOT NULL AND y_lag_3 IS NOT NULL AND y_ma_7 IS NOT NULL""")
def train_matrix(spark, d):
    out = forecasting.train_matrix(p1m(spark, d), "y ~ p(3) + q(7) + trend(1) + dow()", "date", ["series"])
    return rounded(out, "y_ma_7")


# ---------------------------------------------------------------- time axis


@query(f"""WITH {P3}, s AS (SELECT series, date, date_diff('second', lag(date) OVER (PARTITION BY series ORDER BY date), date)::DOUBLE AS step FROM p3),
g AS (SELECT series, median(step) AS m, count(*) FILTER (WHERE step = 0) AS dup, bool_or(isodow(date) > 5) AS weekend FROM s GROUP BY 1)
SELECT median(m) AS median_step, round(stddev_samp(m) / avg(m), 9) AS variation, sum(dup)::BIGINT AS duplicates, bool_or(weekend) AS weekend FROM g""")
def detect_frequency(spark, d):
    return rounded(panel.frequency_stats(panels.hourly_events(spark, d), "date", ["series"]), "variation", to=9)


def _grid(p: str, step: str, where: str = "", kind: str = "DATE", start: str = "min(date)") -> str:
    return f"""g AS (SELECT series, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL {step}))::{kind} AS date FROM (SELECT series, {start} AS lo, max(date) AS hi FROM {p} GROUP BY 1))
SELECT coalesce(g.series, {p}.series) AS series, coalesce(g.date, {p}.date) AS date, y FROM g FULL JOIN {p} ON g.series = {p}.series AND g.date = {p}.date{where}"""


@query(f"WITH {P1}, {_grid('p1', '1 DAY')}")
def fill_time_day(spark, d):
    return panel.fill_time(panels.daily_shipments(spark, d), "date", ["series"], "day").select("series", "date", "y")


@query(f"WITH {P3}, {_grid('p3', '1 HOUR', kind='TIMESTAMP')}")
def fill_time_hour(spark, d):
    return panel.fill_time(panels.hourly_events(spark, d), "date", ["series"], "hour").select("series", "date", "y")


@query(f"WITH {P2}, {_grid('p2', '1 MONTH')}")
def fill_time_month(spark, d):
    return panel.fill_time(panels.monthly_orders(spark, d), "date", ["series"], "month").select("series", "date", "y")


@query(f"WITH {P1}, {_grid('p1', '1 DAY', where=' WHERE isodow(coalesce(g.date, p1.date)) < 6')}")
def fill_time_businessday(spark, d):
    return panel.fill_time(panels.daily_shipments(spark, d), "date", ["series"], "businessday").select("series", "date", "y")


@query(f"WITH {P1}, l AS (SELECT series, max(date) AS last FROM p1 GROUP BY 1) SELECT series, (last + k::INT)::DATE AS date, k::INT AS step FROM l, (SELECT unnest(range(1, 15)) AS k)")
def future_dates_day(spark, d):
    return panel.future_dates(panel.last_dates(panels.daily_shipments(spark, d), "date", ["series"]), "date", 14, "day")


@query(f"WITH {P2}, l AS (SELECT series, max(date) AS last FROM p2 GROUP BY 1) SELECT series, (last + INTERVAL (k) MONTH)::DATE AS date, k::INT AS step FROM l, (SELECT unnest(range(1, 13)) AS k)")
def future_dates_month(spark, d):
    return panel.future_dates(panel.last_dates(panels.monthly_orders(spark, d), "date", ["series"]), "date", 12, "month")


@query(f"""WITH {P1}, l AS (SELECT series, max(date) AS last FROM p1 GROUP BY 1),
c AS (SELECT series, (last + k::INT)::DATE AS date FROM l, (SELECT unnest(range(1, 40)) AS k)),
r AS (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date)::INT AS step FROM c WHERE isodow(date) < 6) SELECT * FROM r WHERE step <= 15""")
def future_dates_businessday(spark, d):
    return panel.future_dates(panel.last_dates(panels.daily_shipments(spark, d), "date", ["series"]), "date", 15, "businessday")


@query(f"WITH {P3}, l AS (SELECT series, max(date) AS last FROM p3 GROUP BY 1) SELECT series, last + INTERVAL (30 * k) MINUTE AS date, k::INT AS step FROM l, (SELECT unnest(range(1, 49)) AS k)")
def future_dates_halfhour(spark, d):
    return panel.future_dates(panel.last_dates(panels.hourly_events(spark, d), "date", ["series"]), "date", 48, "halfhour")


# January 31 and k months, in steps that run over the end of a short month
@query("""SELECT k::INT AS step, (make_date(2020 + (k // 12)::INT, 1 + (k % 12)::INT, 1) + 30)::DATE AS date FROM (SELECT unnest(range(1, 25)) AS k)""")
def future_dates_month_end(spark, d):
    last = spark.createDataFrame([("2020-01-31",)], "date string").withColumn("date", F.col("date").cast("date"))
    return panel.future_dates(last, "date", 24, "month").select("step", "date")


@query(f"""WITH {P1M} SELECT series FROM (SELECT series, arg_max(CASE WHEN y IS NULL THEN 1 ELSE 0 END, date) AS t FROM p GROUP BY 1) WHERE t = 1""")
def trailing_missing(spark, d):
    return panel.trailing_missing(p1m(spark, d), "y", "date", ["series"])


# ---------------------------------------------------------------- imputation

G = "PARTITION BY series ORDER BY date"


@query(f"WITH {P1M} SELECT series, date, coalesce(y, 0) AS y, y IS NULL AS y_is_imputed FROM p")
def impute_zero(spark, d):
    return impute.fill_gaps(p1m(spark, d), "y", "date", ["series"], "zero").select("series", "date", "y", "y_is_imputed")


@query(f"WITH {P1M} SELECT series, date, last_value(y IGNORE NULLS) OVER ({G} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y, y IS NULL AS y_is_imputed FROM p")
def impute_locf(spark, d):
    return impute.fill_gaps(p1m(spark, d), "y", "date", ["series"], "locf", validate=False).select("series", "date", "y", "y_is_imputed")


@query(f"WITH {P1M} SELECT series, date, first_value(y IGNORE NULLS) OVER ({G} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y, y IS NULL AS y_is_imputed FROM p")
def impute_nocb(spark, d):
    return impute.fill_gaps(p1m(spark, d), "y", "date", ["series"], "nocb", validate=False).select("series", "date", "y", "y_is_imputed")


@query(f"""WITH {P1M}, n AS (SELECT *, CASE WHEN y IS NOT NULL THEN date END AS t FROM p),
e AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS y0, last_value(t IGNORE NULLS) OVER b AS t0, first_value(y IGNORE NULLS) OVER a AS y1, first_value(t IGNORE NULLS) OVER a AS t1 FROM n
WINDOW b AS ({G} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({G} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, date, round(coalesce(y, y0 + (y1 - y0) * (date - t0) / (t1 - t0), y0, y1), 6) AS y, y IS NULL AS y_is_imputed FROM e""")
def impute_linear(spark, d):
    return rounded(impute.fill_gaps(p1m(spark, d), "y", "date", ["series"], "linear", extrapolate=True).select("series", "date", "y", "y_is_imputed"), "y")


@query(f"WITH {P1M} SELECT series, date, round(coalesce(y, avg(y) OVER ({G} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 6) AS y, y IS NULL AS y_is_imputed FROM p")
def impute_rolling_mean(spark, d):
    return rounded(impute.fill_gaps(p1m(spark, d), "y", "date", ["series"], "rolling_mean", window=7).select("series", "date", "y", "y_is_imputed"), "y")


def _borrowed(agg: str) -> str:
    return f"""WITH {P4M}, l AS (SELECT g.series, g.date, {agg}(o.y) AS v FROM p g JOIN p o ON g.date = o.date AND g.series <> o.series WHERE g.y IS NULL AND o.y IS NOT NULL GROUP BY 1, 2)
SELECT p.series, p.date, round(coalesce(p.y, v), 6) AS y, p.y IS NULL AND v IS NOT NULL AS y_is_imputed FROM p LEFT JOIN l ON p.series = l.series AND p.date = l.date"""


@query(_borrowed("median"))
def impute_borrow_median(spark, d):
    return rounded(impute.fill_gaps(p4m(spark, d), "y", "date", ["series"], "borrow"), "y")


@query(_borrowed("avg"))
def impute_borrow_mean(spark, d):
    return rounded(impute.fill_gaps(p4m(spark, d), "y", "date", ["series"], "borrow", method="mean"), "y")


@query(f"""WITH {P4M}, pairs AS (SELECT g.series AS s, o.series AS q, avg(abs(g.y - o.y)) AS dist FROM p g JOIN p o ON g.date = o.date AND g.series <> o.series WHERE g.y IS NOT NULL AND o.y IS NOT NULL GROUP BY 1, 2),
allp AS (SELECT a.series AS s, b.series AS q FROM (SELECT DISTINCT series FROM p WHERE y IS NULL) a, (SELECT DISTINCT series FROM p WHERE y IS NOT NULL) b WHERE a.series <> b.series),
w AS (SELECT s, q, 1 / (coalesce(dist, 10 * max(dist) OVER (PARTITION BY s), 1) + 1e-6) AS w FROM allp LEFT JOIN pairs USING (s, q)),
l AS (SELECT g.series, g.date, sum(w.w * o.y) / sum(w.w) AS v FROM p g JOIN p o ON g.date = o.date AND g.series <> o.series JOIN w ON w.s = g.series AND w.q = o.series WHERE g.y IS NULL AND o.y IS NOT NULL GROUP BY 1, 2)
SELECT p.series, p.date, round(coalesce(p.y, v), 6) AS y, p.y IS NULL AND v IS NOT NULL AS y_is_imputed FROM p LEFT JOIN l ON p.series = l.series AND p.date = l.date""")
def impute_borrow_weighted(spark, d):
    return rounded(impute.fill_gaps(p4m(spark, d), "y", "date", ["series"], "borrow", method="weighted"), "y")


@query()
def impute_stl(spark, d):
    p = panel.fill_time(panels.daily_shipments(spark, d), "date", ["series"], "day")
    return impute.fill_gaps(p, "y", "date", ["series"], "stl", period=7).select("series", "date", "y", "y_is_imputed")


def half_last(y, dates, params):
    import numpy as np

    missing, out = np.isnan(y), y.copy()
    for i in np.flatnonzero(missing):
        out[i] = params["share"] * out[i - 1] if i else 0.0
    return out, missing


@query(f"""WITH RECURSIVE {P1M}, r AS (SELECT *, row_number() OVER ({G}) AS n FROM p),
f AS (SELECT series, n, date, y IS NULL AS y_is_imputed, coalesce(y, 0)::DOUBLE AS v FROM r WHERE n = 1
UNION ALL SELECT r.series, r.n, r.date, r.y IS NULL, coalesce(r.y, 0.5 * f.v)::DOUBLE FROM f JOIN r ON r.series = f.series AND r.n = f.n + 1) SELECT series, date, v AS y, y_is_imputed FROM f""")
def impute_custom(spark, d):
    return impute.fill_gaps(p1m(spark, d), "y", "date", ["series"], "custom", fn=half_last, params={"share": 0.5}).select("series", "date", "y", "y_is_imputed")


@query(f"""WITH {P1}, g AS (SELECT series, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM (SELECT series, min(date) lo, max(date) hi FROM p1 GROUP BY 1)),
q AS (SELECT g.series, g.date, CASE WHEN date_diff('day', DATE '1995-01-01', g.date) % 11 > 2 THEN y END AS y FROM g LEFT JOIN p1 USING (series, date)),
r AS (SELECT *, row_number() OVER ({G}) - row_number() OVER (PARTITION BY series, y IS NULL ORDER BY date) AS run FROM q)
SELECT series, min(date) AS first, count(*) AS length FROM r WHERE y IS NULL GROUP BY series, run""")
def gap_runs(spark, d):
    p = panel.fill_time(panels.daily_shipments(spark, d), "date", ["series"], "day")
    days = F.call_function("datediff", F.col("date"), F.lit("1995-01-01").cast("date"))
    p = p.withColumn("y", F.when(F.pmod(days, F.lit(11)) > 2, F.col("y")))
    return impute.gap_runs(p, "y", "date", ["series"]).select("series", "first", "length")


@query(f"WITH {P1M} SELECT count(*) FILTER (WHERE y IS NULL) AS n_imputed, count(*) AS n_total, round(100.0 * count(*) FILTER (WHERE y IS NULL) / count(*), 6) AS pct_imputed FROM p")
def imputation_summary(spark, d):
    return rounded(impute.imputation_summary(impute.fill_gaps(p1m(spark, d), "y", "date", ["series"], "zero"), "y"), "pct_imputed")


@query(f"""WITH {P1}, g AS (SELECT series, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM (SELECT series, min(date) lo, max(date) hi FROM p1 GROUP BY 1)),
q AS (SELECT g.series, g.date, y, x FROM g LEFT JOIN p1 USING (series, date))
SELECT series, date, coalesce(y, 0) AS y, y IS NULL AS y_is_imputed, last_value(x IGNORE NULLS) OVER ({G} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x, x IS NULL AS x_is_imputed FROM q""")
def clean_pipeline(spark, d):
    ts = panel.TimeSeriesFrame.create(panels.daily_shipments(spark, d), "date", "series", "day", target="y", fill_time_gaps=True, target_na={"strategy": "zero"}, xreg_na={"x": {"strategy": "locf"}}, validate=False)
    return ts.df.select("series", "date", "y", "y_is_imputed", "x", "x_is_imputed")


# ---------------------------------------------------------------- models and forecasts


@query(f"WITH {P1}, l AS (SELECT y, lag(y) OVER ({G}) AS x FROM p1) SELECT round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope FROM l WHERE x IS NOT NULL")
def ols_p1_coef(spark, d):
    f = forecasting.fit("y ~ p(1)", panels.daily_shipments(spark, d), date="date", groups=["series"], frequency="day")
    return rounded(spark.createDataFrame([(f.model.intercept, f.model.coef["y_lag_1"])], "intercept double, slope double"), "intercept", "slope")


RECURSE = """l AS (SELECT y, lag(y) OVER (PARTITION BY series ORDER BY date) AS x FROM p1), m AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM l WHERE x IS NOT NULL),
f AS (SELECT series, max(date) AS date, arg_max(y, date)::DOUBLE AS v, 0 AS k FROM p1 GROUP BY 1
UNION ALL SELECT series, (date + 1)::DATE, a + b * v, k + 1 FROM f, m WHERE k < 14)
SELECT series, date, round(v, 4) AS y_forecast FROM f WHERE k > 0"""


@query(f"WITH RECURSIVE {P1}, {RECURSE}")
def forecast_p1_recursive(spark, d):
    f = forecasting.fit("y ~ p(1)", panels.daily_shipments(spark, d), date="date", groups=["series"], frequency="day")
    return rounded(f.forecast(14), "y_forecast", to=4)


def pooled_mean_model():
    """OLS written as two functions, for the pandas path."""

    def fitted(y, x):
        import numpy as np

        a = np.column_stack([np.ones(len(x)), x.to_numpy(float)])
        return np.linalg.lstsq(a, y, rcond=None)[0]

    return models.PandasModel(fitted, lambda b, x: b[0] + x.to_numpy(float) @ b[1:])


@query(f"WITH RECURSIVE {P1}, {RECURSE}")
def forecast_pandas_model(spark, d):
    f = forecasting.fit("y ~ p(1)", panels.daily_shipments(spark, d), pooled_mean_model(), date="date", groups=["series"], frequency="day")
    return rounded(f.forecast(14), "y_forecast", to=4)


@query(f"""WITH {P1}, t AS (SELECT *, row_number() OVER ({G}) AS rn FROM p1), m AS (SELECT regr_intercept(y, rn) AS a, regr_slope(y, rn) AS b FROM t),
l AS (SELECT series, max(date) AS last, count(*) AS n FROM p1 GROUP BY 1)
SELECT series, (last + k::INT)::DATE AS date, round(a + b * (n + k), 4) AS y_forecast FROM l, m, (SELECT unnest(range(1, 15)) AS k)""")
def forecast_trend_batch(spark, d):
    f = forecasting.fit("y ~ trend(1)", panels.daily_shipments(spark, d), date="date", groups=["series"], frequency="day")
    return rounded(f.forecast(14), "y_forecast", to=4)


@query(f"""WITH {P1}, m AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM p1), l AS (SELECT series, max(date) AS last, arg_max(x, date) AS x FROM p1 GROUP BY 1)
SELECT series, (last + k::INT)::DATE AS date, round(a + b * x, 4) AS y_forecast FROM l, m, (SELECT unnest(range(1, 8)) AS k)""")
def xreg_carry_last(spark, d):
    f = forecasting.fit("y ~ x", panels.daily_shipments(spark, d), date="date", groups=["series"], frequency="day")
    return rounded(f.forecast(7, xreg_strategy="carry"), "y_forecast", to=4)


@query(f"""WITH {P1}, l1 AS (SELECT series, date, y, x, lag(x, 2) OVER ({G}) AS x2 FROM p1), m AS (SELECT regr_intercept(y, x2) AS a, regr_slope(y, x2) AS b FROM l1 WHERE x2 IS NOT NULL),
z AS (SELECT series, max(date) AS last FROM p1 GROUP BY 1), u AS (SELECT series, (last + k::INT)::DATE AS date, (100 * k)::BIGINT AS x FROM z, (SELECT unnest(range(1, 6)) AS k)),
b AS (SELECT series, date, x, 0 AS new FROM p1 UNION ALL SELECT series, date, x, 1 FROM u), w AS (SELECT *, lag(x, 2) OVER ({G}) AS x2 FROM b)
SELECT series, date, round(a + b * x2, 4) AS y_forecast FROM w, m WHERE new = 1""")
def xreg_future_lag(spark, d):
    p = panels.daily_shipments(spark, d)
    f = forecasting.fit("y ~ lag(x, 2)", p, date="date", groups=["series"], frequency="day")
    future = panel.future_dates(panel.last_dates(p, "date", ["series"]), "date", 5, "day").select("series", "date", (F.col("step") * 100).cast("long").alias("x"))
    return rounded(f.forecast(future=future), "y_forecast", to=4)


@query()
def forecast_calendar_lags(spark, d):
    """Lags, rolling features, trend and weekday together, folded natively."""
    return flagship(spark, d)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel -> calendar completion -> zero fill -> OLS on lags, trend and weekday -> 14 days."""
    ts = panel.TimeSeriesFrame.create(panels.daily_shipments(spark, sf_dir), "date", "series", "day", target="y", fill_time_gaps=True, target_na={"strategy": "zero"}, validate=False)
    return forecasting.fit("y ~ p(7) + trend(1) + dow()", ts).forecast(14)


@query()
def forecast_users(spark, d):
    """Weekly lags over one series per user."""
    ts = panel.TimeSeriesFrame.create(panels.user_days(spark, d), "date", "series", "day", target="y", fill_time_gaps=True, target_na={"strategy": "zero"}, validate=False)
    return forecasting.fit("y ~ p(7)", ts).forecast(14)


# ---------------------------------------------------------------- cross-validation

CV = dict(date="date", groups=["series"], frequency="month", h=3, n_windows=4)


@query(f"""WITH {P2A}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS place FROM (SELECT DISTINCT date FROM p2)), n AS (SELECT max(place) AS n FROM d),
f AS (SELECT k + 1 AS fold, n - 9 + 3 * k AS te FROM n, (SELECT unnest(range(0, 4)) AS k))
SELECT fold::INT AS fold, (SELECT date FROM d WHERE place = 1) AS train_start, (SELECT date FROM d WHERE place = te - 3) AS train_end, (SELECT date FROM d WHERE place = te - 2) AS test_start, (SELECT date FROM d WHERE place = te) AS test_end FROM f""")
def cv_folds(spark, d):
    days = [r.date for r in aligned_orders(spark, d).select("date").distinct().orderBy("date").collect()]  # a few dozen months
    rows = [(f.fold, *(days[p - 1] for p in (f.train_start, f.train_end, f.test_start, f.test_end))) for f in validation.folds(len(days), 3, 4)]
    return spark.createDataFrame(rows, "fold int, train_start date, train_end date, test_start date, test_end date")


def _lists(table: str) -> str:
    return f"SELECT '{table}' AS panel, count(*) AS n_series, count(DISTINCT l) AS n_date_lists FROM (SELECT series, list(date ORDER BY date) AS l FROM {table} GROUP BY 1)"


@query(f"WITH {P2A}, p4 AS (SELECT user_id AS series, ts::DATE AS date FROM events GROUP BY 1, 2) {_lists('p2')} UNION ALL {_lists('p2raw')} UNION ALL {_lists('p4')}")
def cv_alignment(spark, d):
    """Series and different lists of dates: of the shared months, of all months, and of the users' days, which cross-validation refuses."""
    found = {"p2": aligned_orders(spark, d), "p2raw": panels.monthly_orders(spark, d), "p4": panels.user_days(spark, d)}
    parts = [validation.alignment(p, "date", ["series"]).select(F.lit(name).alias("panel"), "*") for name, p in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# a model of the trend alone: each fold's forecast is a regression on the row number
CV_PRED = f"""{P2A}, d AS (SELECT *, row_number() OVER ({G}) AS rn FROM p2), n AS (SELECT max(rn) AS n FROM d), f AS (SELECT k + 1 AS fold, n - 9 + 3 * k AS te FROM n, (SELECT unnest(range(0, 4)) AS k)),
m AS (SELECT fold, te, regr_intercept(y, rn) AS a, regr_slope(y, rn) AS b FROM f JOIN d ON rn <= te - 3 GROUP BY 1, 2),
p AS (SELECT fold, series, date, y AS actual, a + b * rn AS predicted FROM m JOIN d ON rn BETWEEN te - 2 AND te)"""


@query(f"WITH {CV_PRED} SELECT fold::INT AS fold, series, date, actual, round(predicted, 4) AS predicted FROM p")
def cv_predictions(spark, d):
    out = validation.cv_forecast("y ~ trend(1)", aligned_orders(spark, d), return_predictions=True, **CV)
    return rounded(out.predictions, "predicted", to=4)


SQL_METRIC = {"rmse": "sqrt(avg((actual - predicted) ** 2))", "mse": "avg((actual - predicted) ** 2)", "mae": "avg(abs(actual - predicted))", "mape": "100 * avg(abs((actual - predicted) / nullif(actual, 0)))"}


def _cv_query(name: str):
    def run(spark, d):
        out = validation.cv_forecast("y ~ trend(1)", aligned_orders(spark, d), metric=name, **CV)
        return rounded(out.metrics.where("fold > 0").withColumn("fold", F.col("fold").cast("int")), name, to=2)

    run.__name__ = f"cv_metrics_{name}"
    query(f"WITH {CV_PRED} SELECT fold::INT AS fold, round({SQL_METRIC[name]}, 2) AS {name}, count(*) AS n_test FROM p GROUP BY 1")(run)


for _name in validation.METRICS:
    _cv_query(_name)


@query(f"WITH {CV_PRED} SELECT 0::INT AS fold, round({SQL_METRIC['rmse']}, 2) AS rmse, count(*) AS n_test FROM p")
def cv_overall(spark, d):
    out = validation.cv_forecast("y ~ trend(1)", aligned_orders(spark, d), **CV)
    return rounded(out.metrics.where("fold = 0").withColumn("fold", F.col("fold").cast("int")), "rmse", to=2)


@query(f"""WITH {CV_PRED}, s AS (SELECT row_number() OVER (PARTITION BY fold, series ORDER BY date)::INT AS step, * FROM p) SELECT step, round({SQL_METRIC['mae']}, 2) AS mae FROM s GROUP BY 1""")
def cv_accuracy_by_step(spark, d):
    out = validation.cv_forecast("y ~ trend(1)", aligned_orders(spark, d), return_predictions=True, **CV)
    return rounded(validation.accuracy_by_step(out.predictions, "date", ["series"], "mae"), "mae", to=2)


@query(f"WITH {CV_PRED} SELECT series, round({SQL_METRIC['mae']}, 2) AS mae FROM p GROUP BY 1")
def cv_accuracy_by_group(spark, d):
    out = validation.cv_forecast("y ~ trend(1)", aligned_orders(spark, d), return_predictions=True, **CV)
    return rounded(validation.accuracy_by_group(out.predictions, ["series"], "mae"), "mae", to=2)


# ---------------------------------------------------------------- names of steps, and what is refused

DAYS = (1, 1.4, 2, 3, 6, 7, 10, 12, 13, 14, 15, 20, 28, 30, 31, 32, 61, 88, 89, 91, 92, 180, 364, 365, 366, 367, 400)
SECONDS = (1, 54, 57, 60, 66, 1700, 1800, 1900, 3300, 3600, 3950, 43200, 86400, 604800)


@query(f"""WITH s AS (SELECT unnest({list(DAYS)})::DOUBLE AS days, NULL::DOUBLE AS seconds UNION ALL SELECT x / 86400, x FROM (SELECT unnest({list(SECONDS)})::DOUBLE AS x))
SELECT days, seconds, CASE WHEN seconds = 1 THEN 'second' WHEN abs(seconds - 60) < 6 THEN 'minute' WHEN abs(seconds - 1800) < 180 THEN 'halfhour' WHEN abs(seconds - 3600) < 360 THEN 'hour'
  WHEN round_even(days, 0) < 1 THEN 'refused' WHEN abs(days - 1) < 0.5 THEN 'day' WHEN abs(days - 7) < 0.5 THEN 'week' WHEN abs(days - 14) < 1 THEN 'biweekly'
  WHEN days BETWEEN 28 AND 31 THEN 'month' WHEN days BETWEEN 89 AND 92 THEN 'quarter' WHEN days BETWEEN 364 AND 367 THEN 'year' ELSE round_even(days, 0)::BIGINT::VARCHAR END AS name FROM s""")
def frequency_names(spark, d):
    """The step that a median distance stands for, for dates and timestamps."""

    def name(seconds: float, dates: bool) -> str:
        try:
            return str(panel.frequency_of(seconds, True, dates).name)
        except ValueError:
            return "refused"

    rows = [(float(x), None, name(x * 86400, True)) for x in DAYS] + [(x / 86400, float(x), name(x, False)) for x in SECONDS]
    return spark.createDataFrame(rows, "days double, seconds double, name string")


def _refusals(spark, d) -> dict:
    """Calls that must raise, on the driver's tables."""
    p, gaps = panels.daily_shipments(spark, d), p1m(spark, d)
    last = F.max("date").over(Window.partitionBy("series"))
    first = F.min("date").over(Window.partitionBy("series"))
    trailing = p.withColumn("y", F.when(F.col("date") < last, F.col("y")))
    leading = p.withColumn("y", F.when(F.col("date") > first, F.col("y")))
    long = p.withColumn("y", F.when(F.dayofmonth("date") > 9, F.col("y")))
    fill = lambda df, how, **kw: impute.fill_gaps(df, "y", "date", ["series"], how, **kw)
    fitted = lambda df: forecasting.fit("y ~ p(1)", df, date="date", groups=["series"], frequency="day")
    some = p.withColumn("last", last).where(F.col("date") > F.date_sub("last", 3)).select("series", "date")
    return {
        "error_with_gaps": lambda: fill(gaps, "error"),
        "locf_leading": lambda: fill(leading, "locf"),
        "nocb_trailing": lambda: fill(trailing, "nocb"),
        "linear_leading": lambda: fill(leading, "linear"),
        "max_gap": lambda: fill(long, "nocb", max_gap=3),
        "max_gap_held": lambda: fill(long.where(F.dayofmonth("date") > 7), "linear", max_gap=2, extrapolate=True),
        "unknown_strategy": lambda: fill(p, "guess"),
        "forecast_trailing": lambda: fitted(trailing).forecast(3),
        "forecast_complete": lambda: fitted(p).forecast(3),
        "future_date_twice": lambda: fitted(p).forecast(future=some.unionByName(some)),
        "future_without_dates": lambda: fitted(p).forecast(future=some.drop("date")),
        "horizon_zero": lambda: fitted(p).forecast(0),
        "cv_different_dates": lambda: validation.cv_forecast("y ~ trend(1)", panels.user_days(spark, d), date="date", groups=["series"], frequency="day", h=1),
        "cv_window_missing": lambda: validation.folds(50, 3, 2, "sliding"),
        "cv_unknown_metric": lambda: validation.cv_forecast("y ~ trend(1)", p, date="date", groups=["series"], frequency="day", metric="best"),
        "lag_zero": lambda: forecasting.fit("y ~ p(0)", p, date="date", groups=["series"]),
        "unknown_column": lambda: forecasting.fit("y ~ nothing", p, date="date", groups=["series"]),
        "days_not_whole": lambda: panel.Frequency.of(1.5),
        "unknown_frequency": lambda: panel.Frequency.of("hourly"),
        "hours_of_dates": lambda: panel.fill_time(p, "date", ["series"], "hour"),
    }


#: The calls above that go through.
GRANTED = ("max_gap_held", "forecast_complete")
REFUSALS = (
    "error_with_gaps", "locf_leading", "nocb_trailing", "linear_leading", "max_gap", "max_gap_held", "unknown_strategy", "forecast_trailing", "forecast_complete", "future_date_twice",
    "future_without_dates", "horizon_zero", "cv_different_dates", "cv_window_missing", "cv_unknown_metric", "lag_zero", "unknown_column", "days_not_whole", "unknown_frequency", "hours_of_dates",
)


@query(f"SELECT c AS call, c NOT IN {GRANTED} AS refused FROM (SELECT unnest({list(REFUSALS)}) AS c)")
def refusals(spark, d):
    """Which calls raise: gaps that cannot be filled, forecasts from missing values, folds over different dates, bad arguments."""

    def refused(call) -> bool:
        try:
            call()
        except (ValueError, TypeError):
            return True
        return False

    return spark.createDataFrame([(name, refused(call)) for name, call in _refusals(spark, d).items()], "call string, refused boolean")


@query(f"""WITH {P4}, s AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY series ORDER BY date), date) AS s FROM p4),
m AS (SELECT series, max(date) AS date, greatest(1, floor(coalesce(median(s), 1)))::INT AS m FROM s GROUP BY 1)
SELECT series, (date + (k * m)::INT)::DATE AS date, k::INT AS step FROM m, (SELECT unnest(range(1, 6)) AS k)""")
def median_step_future(spark, d):
    """Future dates by each user's own median step."""
    return panel.median_step_dates(panels.user_days(spark, d), "date", ["series"], 5).select("series", "date", "step")


@query(f"""WITH {P4}, t AS (SELECT series, max(date) AS date FROM p4 GROUP BY 1) SELECT series FROM t WHERE date_diff('day', DATE '1995-01-01', date) % 3 = 0""")
def trailing_missing_users(spark, d):
    """Users whose last day has no value, where every third day is masked."""
    return panel.trailing_missing(panels.masked(panels.user_days(spark, d), 3), "y", "date", ["series"])


@query("""WITH t AS (SELECT id, (id % 42)::INT AS i, (id // 42)::INT AS m FROM (SELECT unnest(range(0, 42 * 333)) AS id))
SELECT printf('item%02d', i) AS items, (DATE '1997-04-01' + INTERVAL (m) MONTH)::DATE AS date FROM t""")
def retail_panel(spark, d):
    return panels.retail(spark).select("items", "date")



