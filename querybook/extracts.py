"""K: plot-ready extracts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from panelspark.models.engine import fit_all
from panelspark.models.lasso import lasso_path
from panelspark.models.linear import residualize
from panelspark.models.spec import ModelSpec
from panelspark.operators import extracts as X
from panelspark.operators.clean import complete_cases, poly
from panelspark.operators.panel import Panel, difference, lag_by
from panelspark.operators.reshape import literal_table

from . import lasso_sql as Z
from .common import DAILY_SQL, WEEKLY_SQL, daily_types, query, rounded, sig, sig_sql, table, weekly_panel, weekly_table, with_sql
from .models import LAG_SQL, LASSO_X
from .windows import DELAY_SQL, delays


@query(
    "K1_histogram",
    "WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS m FROM orders), "
    "b AS (SELECT CAST(least(40, floor((o_totalprice - lo) / ((hi - lo) / 40)) + 1) AS INTEGER) AS bin, lo, hi, m FROM orders, s) "
    f"SELECT bin, {sig_sql('lo + (hi - lo) / 40 * (bin - 0.5)')} AS mid, count(*) AS n, {sig_sql('m')} AS mean FROM b GROUP BY bin, lo, hi, m",
)
def k1(spark, sf):
    return rounded(X.histogram(table(spark, sf, "orders"), "o_totalprice", 40), ["mid", "mean"])


@query(
    "K2_residual_scatter",
    with_sql(
        WEEKLY_SQL,
        "b AS (SELECT regr_slope(price, qty) AS b1, regr_intercept(price, qty) AS a1, regr_slope(revenue, qty) AS b2, regr_intercept(revenue, qty) AS a2 FROM weekly)",
        "r AS (SELECT (price - a1 - b1 * qty) / 1e5 AS x, (revenue - a2 - b2 * qty) / 1e5 AS y FROM weekly, b)",
        "p AS (SELECT * FROM r WHERE x BETWEEN -0.45 AND 0.45)",
        "l AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM p)",
    )
    + ", ".join(["SELECT " + sig_sql("x", 7, "1e-6") + " AS x", sig_sql("y", 7, "1e-6") + " AS y", sig_sql("slope", 7) + " AS slope", sig_sql("intercept + slope * x", 6, "1e-5") + " AS line"]) + " FROM p, l",
)
def k2(spark, sf):
    p = weekly_table(spark, sf, "revenue", "price", "qty")
    p = residualize(p, ModelSpec("p", "price", ["qty"]), "rx")
    p = residualize(p, ModelSpec("r", "revenue", ["qty"]), "ry")
    p = p.select((F.col("rx") / 1e5).alias("rx"), (F.col("ry") / 1e5).alias("ry"))
    out = X.scatter(p, "rx", "ry", (-0.45, 0.45))
    return out.select(sig("x", 7, 1e-6).alias("x"), sig("y", 7, 1e-6).alias("y"), sig("slope", 7).alias("slope"), sig("line", 6, 1e-5).alias("line"))


@query(
    "K3_fit_curve",
    with_sql(
        WEEKLY_SQL,
        "d AS (SELECT log10(price) AS x, log10(price) * log10(price) AS x2, log10(revenue) AS y FROM weekly)",
        "c AS (SELECT var_pop(x) AS s11, var_pop(x2) AS s22, covar_pop(x, x2) AS s12, covar_pop(x, y) AS s1, covar_pop(x2, y) AS s2, avg(x) AS m1, avg(x2) AS m2, avg(y) AS my, min(x) AS lo, max(x) AS hi FROM d)",
        "f AS (SELECT *, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2 FROM c)",
        "g AS (SELECT lo + i * (hi - lo) / 49 AS x, b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM f, (SELECT unnest(range(50)) AS i))",
    )
    + f"SELECT {sig_sql('pow(10, x)', 6)} AS x, {sig_sql('pow(10, b0 + b1 * x + b2 * x * x)', 5)} AS y FROM g",
)
def k3(spark, sf):
    p = weekly_table(spark, sf, "price", "revenue").select(F.log10("price").alias("x"), F.log10("revenue").alias("y"))
    fit = fit_all(p, [ModelSpec("curve", "y", poly("x", 2))])[0]
    lo, hi = p.agg(F.min("x"), F.max("x")).first()
    grid = X.curve_grid(spark, lo, hi, 50, {0: fit.coef("_cons"), 1: fit.coef("x"), 2: fit.coef("x^2")}, log10=True)
    return grid.select(sig("x", 6).alias("x"), sig("y", 5).alias("y"))


@query(
    "K4_series_with_markers",
    with_sql(DAILY_SQL, "d AS (SELECT date, n, v, n - lag(n) OVER (ORDER BY date) AS d_n FROM daily WHERE state = 'error')")
    + "SELECT date, 'events' AS series, n / 10.0 AS value, 'line' AS kind FROM d UNION ALL SELECT date, 'change', CAST(d_n AS DOUBLE), 'line' FROM d "
    "UNION ALL SELECT * FROM (VALUES (DATE '2024-01-10', 'restriction', NULL::DOUBLE, 'event'), (DATE '2024-01-20', 'stay_home', NULL, 'event'))",
)
def k4(spark, sf):
    d = difference(Panel(daily_types(spark, sf), "state", "date"), ["n"])
    lines = X.series(d, "date", {"events": F.col("n") / 10, "change": "d_n"}, F.col("state") == "error")
    marks = literal_table(spark, [(date(2024, 1, 10), "restriction"), (date(2024, 1, 20), "stay_home")], "date date, policy string")
    return X.with_markers(lines, marks, "date", "policy")


@query("K5_delay_bars", DELAY_SQL + f"SELECT user_id, {sig_sql('avg(a)')} AS delay FROM x GROUP BY 1")
def k5(spark, sf):
    return rounded(X.bars(delays(spark, sf), "user_id", "ndays_first_case", "delay"), ["delay"])


@query("K6_coefficient_path", Z.path_sql(LAG_SQL[:2], "(SELECT * FROM lags WHERE qty_m4 IS NOT NULL)", "revenue", LASSO_X))
def k6(spark, sf):
    p = lag_by(Panel(weekly_panel(spark, sf), "state", "t"), ["qty"], [1, 2, 3, 4])
    out = lasso_path(complete_cases(p, LASSO_X), "revenue", LASSO_X).table(spark)
    return out.select("step", sig("lambda", 6).alias("lambda"), "term", sig("estimate", 5, 1e-6).alias("estimate"))
