"""J: estimators. SQL forms are closed forms for one or two regressors."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.models import bygroup, factors, grid as G, lasso, linear, wald
from panelspark.models.engine import fit_all
from panelspark.models.spec import ModelSpec, coefficients
from panelspark.models.tables import coef_table
from panelspark.operators.clean import cross_factors, interact, poly
from panelspark.operators.extracts import corr_matrix
from panelspark.operators.panel import Panel, lag_by, panel_features
from panelspark.session import materialize, scratch_path
from panelspark.sources.writers import export_table

from . import lasso_sql as Z
from . import suite_sql as Q
from .common import WEEKLY_SQL, query, rounded, sig, sig_sql, table, weekly_panel, weekly_table, with_sql

S7 = 7


def coef_row(spark, fits, terms=None, digits=S7):
    """(model_id, term, estimate, std_error) rounded for comparison."""
    out = coefficients(spark, fits)
    if terms:
        out = out.filter(F.col("term").isin(*terms))
    return out.select("model_id", "term", sig("estimate", digits).alias("estimate"), sig("std_error", digits).alias("std_error"))


def one_sql(name, term, b, v, src, digits=S7):
    """SELECT with slope b and variance v from a one-row source."""
    return (
        f"SELECT '{name}' AS model_id, '{term}' AS term, {sig_sql(b, digits)} AS estimate, {sig_sql(f'sqrt({v})', digits)} AS std_error FROM {src}"
    )


def simple(src="weekly", y="revenue", x="qty"):
    """CTEs of a one-regressor fit with constant: b(n, sxx, xm, slope, icpt) and e(x, dx, err)."""
    return (
        f"b AS (SELECT count(*) AS n, regr_sxx({y}, {x}) AS sxx, regr_avgx({y}, {x}) AS xm, regr_slope({y}, {x}) AS slope, "
        f"regr_intercept({y}, {x}) AS icpt FROM {src})",
        f"e AS (SELECT s.*, {x} - xm AS dx, {y} - icpt - slope * {x} AS err, n, sxx, slope FROM {src} s, b)",
    )


@query(
    "J1_ols_hc1",
    with_sql(WEEKLY_SQL, *simple(), "v AS (SELECT max(slope) AS b, max(n) / (max(n) - 2.0) * sum(err * err * dx * dx) / max(sxx * sxx) AS v FROM e)")
    + one_sql("ols", "qty", "b", "v", "v"),
)
def j1(spark, sf):
    return coef_row(spark, [linear.ols(weekly_panel(spark, sf), "revenue", ["qty"])], ["qty"])


@query(
    "J2_ols_cluster",
    with_sql(
        WEEKLY_SQL, *simple(),
        "g AS (SELECT state, sum(err * dx) AS s, max(n) AS n, max(sxx) AS sxx, max(slope) AS slope FROM e GROUP BY 1)",
        "v AS (SELECT max(slope) AS b, count(*) / (count(*) - 1.0) * (max(n) - 1.0) / (max(n) - 2.0) * sum(s * s) / max(sxx * sxx) AS v FROM g)",
    )
    + one_sql("ols", "qty", "b", "v", "v"),
)
def j2(spark, sf):
    return coef_row(spark, [linear.ols(weekly_panel(spark, sf), "revenue", ["qty"], vce="cluster", cluster="state")], ["qty"])


@query(
    "J3_ols_classical",
    with_sql(WEEKLY_SQL, *simple(), "v AS (SELECT max(slope) AS b, sum(err * err) / (max(n) - 2.0) / max(sxx) AS v FROM e)")
    + one_sql("ols", "qty", "b", "v", "v"),
)
def j3(spark, sf):
    return coef_row(spark, [linear.ols(weekly_panel(spark, sf), "revenue", ["qty"], vce="classical")], ["qty"])


HC2 = "sum(dx * dx * err * err / (1 - 1.0 / n - dx * dx / sxx)) / max(sxx * sxx)"


@query(
    "J4_ols_hc2",
    with_sql(WEEKLY_SQL, *simple(), f"v AS (SELECT max(slope) AS b, {HC2} AS v FROM e)") + one_sql("ols", "qty", "b", "v", "v"),
)
def j4(spark, sf):
    return coef_row(spark, [linear.ols(weekly_panel(spark, sf), "revenue", ["qty"], vce="hc2")], ["qty"])


GROUPED = (
    "b AS (SELECT state, count(*) AS n, regr_sxx(revenue, qty) AS sxx, regr_avgx(revenue, qty) AS xm, regr_slope(revenue, qty) AS slope, regr_intercept(revenue, qty) AS icpt FROM weekly GROUP BY 1)",
    "e AS (SELECT state, qty - xm AS dx, revenue - icpt - slope * qty AS err, n, sxx, slope FROM weekly JOIN b USING (state))",
    f"v AS (SELECT state, max(slope) AS b, {HC2} AS v, max(n) AS n FROM e GROUP BY 1)",
)


@query(
    "J5_regression_per_group",
    with_sql(WEEKLY_SQL, *GROUPED) + f"SELECT state, n::BIGINT AS n, {sig_sql('b', S7)} AS estimate, {sig_sql('sqrt(v)', S7)} AS std_error, {sig_sql('b / sqrt(v)', 6)} AS statistic FROM v",
)
def j5(spark, sf):
    out = bygroup.ols_by(weekly_table(spark, sf, "state", "revenue", "qty"), "state", "revenue", "qty")
    return out.select("state", F.col("n").cast("long").alias("n"), sig("estimate", S7).alias("estimate"), sig("std_error", S7).alias("std_error"), sig("statistic", 6).alias("statistic"))


def demeaned(src, cols, by="state", extra=""):
    return f"SELECT {by}{extra}, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {by}) AS {c}" for c in cols) + f" FROM {src}"


def fe_fit(src, y, x, g="state", k_extra="0"):
    """Within fit of demeaned columns with entity-cluster variance."""
    return (
        f"m AS (SELECT count(*) AS n, count(DISTINCT {g}) AS g, sum({x} * {y}) / sum({x} * {x}) AS b, sum({x} * {x}) AS sxx FROM {src})",
        f"s AS (SELECT {g}, sum({x} * ({y} - b * {x})) AS s FROM {src}, m GROUP BY 1)",
        f"v AS (SELECT max(b) AS b, max(g) / (max(g) - 1.0) * (max(n) - 1.0) / (max(n) - max(g) - 1.0 - {k_extra}) * sum(s * s) / max(sxx * sxx) AS v FROM s, m)",
    )


@query(
    "J6_entity_effects",
    with_sql(WEEKLY_SQL, "d AS (" + demeaned("weekly", ["revenue", "qty"]) + ")", *fe_fit("d", "revenue", "qty")) + one_sql("fe", "qty", "b", "v", "v"),
)
def j6(spark, sf):
    spec = ModelSpec("fe", "revenue", ["qty"], entity="state", vce="cluster", cluster="state")
    return coef_row(spark, [linear.fit(weekly_panel(spark, sf), spec)], ["qty"])


def detrend(src, cols, t="t", out="d1"):
    """Residuals of each column from its entity's line in t."""
    parts = ", ".join(f"regr_slope({c}, {t}) AS s_{c}, regr_intercept({c}, {t}) AS i_{c}" for c in cols)
    cols_sql = ", ".join(f"{c} - i_{c} - s_{c} * {t} AS {c}" for c in cols)
    return f"{out}_c AS (SELECT state, {parts} FROM {src} GROUP BY 1), {out} AS (SELECT state, {cols_sql} FROM {src} JOIN {out}_c USING (state))"


@query(
    "J7_linear_trends",
    with_sql(WEEKLY_SQL, detrend("weekly", ["revenue", "qty"]), *fe_fit("d1", "revenue", "qty", k_extra="max(g)")) + one_sql("trend", "qty", "b", "v", "v"),
)
def j7(spark, sf):
    spec = ModelSpec("trend", "revenue", ["qty"], entity="state", trend=("t", 1), vce="cluster", cluster="state")
    return coef_row(spark, [linear.fit(weekly_panel(spark, sf), spec)], ["qty"])


@query(
    "J7_quadratic_trends",
    with_sql(
        WEEKLY_SQL,
        "w2 AS (SELECT state, t, (t / 100.0) * (t / 100.0) AS t2, revenue, qty FROM weekly)",
        detrend("w2", ["revenue", "qty", "t2"]),
        detrend("d1", ["revenue", "qty"], t="t2", out="d2"),
        *fe_fit("d2", "revenue", "qty", k_extra="2 * max(g)"),
    )
    + one_sql("trend", "qty", "b", "v", "v"),
)
def j7q(spark, sf):
    spec = ModelSpec("trend", "revenue", ["qty"], entity="state", trend=("t", 2), vce="cluster", cluster="state")
    return coef_row(spark, [linear.fit(weekly_panel(spark, sf), spec)], ["qty"])


@query(
    "J8_period_effects",
    with_sql(
        WEEKLY_SQL,
        "d AS (" + demeaned("weekly", ["revenue", "qty"], by="wk") + ")",
        "m AS (SELECT count(*) AS n, count(DISTINCT wk) AS g, sum(qty * revenue) / sum(qty * qty) AS b, sum(qty * qty) AS sxx FROM d)",
        "v AS (SELECT max(b) AS b, max(n) / (max(n) - max(g) - 1.0) * sum(qty * qty * (revenue - b * qty) * (revenue - b * qty)) / max(sxx * sxx) AS v FROM d, m)",
    )
    + one_sql("period", "qty", "b", "v", "v"),
)
def j8(spark, sf):
    return coef_row(spark, [linear.ols(weekly_panel(spark, sf), "revenue", ["qty"], name="period", entity="wk")], ["qty"])


FAR = "CAST(regexp_extract(state, '[0-9]+') AS DOUBLE)"


@query(
    "J6_entity_levels_far_apart",
    with_sql(
        WEEKLY_SQL,
        f"far AS (SELECT state, revenue + 1e9 * {FAR} AS revenue, qty + 1e6 * {FAR} AS qty FROM weekly)",
        "d AS (" + demeaned("far", ["revenue", "qty"]) + ")",
        *fe_fit("d", "revenue", "qty"),
    )
    + one_sql("far", "qty", "b", "v", "v"),
)
def j6_far(spark, sf):
    level = F.regexp_extract("state", "[0-9]+", 0).cast("double")
    panel = weekly_panel(spark, sf).withColumns({"revenue": F.col("revenue") + 1e9 * level, "qty": F.col("qty") + 1e6 * level})
    return coef_row(spark, [linear.fit(panel, ModelSpec("far", "revenue", ["qty"], entity="state", vce="cluster", cluster="state"))], ["qty"])


def swept(src, cols, rounds):
    """CTEs that take entity and period means out in turn; the last is ``p<rounds>``."""
    out, at = [], src
    for k in range(1, rounds + 1):
        for name, by in (("a", "state"), ("p", "wk")):
            out.append(f"{name}{k} AS (SELECT state, wk, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {by}) AS {c}" for c in cols) + f" FROM {at})")
            at = f"{name}{k}"
    return out


TWO_WAY = (
    *swept("weekly", ["revenue", "qty"], 15),
    *fe_fit("p15", "revenue", "qty", k_extra="(SELECT count(DISTINCT wk) - 1 FROM weekly)"),
)


@query(
    "J8_two_way_fit",
    with_sql(
        WEEKLY_SQL,
        *TWO_WAY,
        "r AS (SELECT 1 - sum(power(revenue - b * qty, 2)) / (SELECT var_pop(revenue) * count(*) FROM weekly) AS r2, count(*) AS n FROM p15, v)",
        "k AS (SELECT count(DISTINCT wk) + count(DISTINCT state) AS k FROM weekly)",
    )
    + f"SELECT {sig_sql('b', S7)} AS estimate, {sig_sql('sqrt(v)', S7)} AS std_error, {sig_sql('r2', S7)} AS r2, "
    f"{sig_sql('1 - (1 - r2) * (n - 1) / (n - k)', S7)} AS adj_r2 FROM v, r, k",
)
def j8_two_way_fit(spark, sf):
    panel = weekly_table(spark, sf, "state", "wk", "revenue", "qty")
    fit = linear.fit_two_way(panel, ModelSpec("two_way", "revenue", ["qty"], entity="state", vce="cluster", cluster="state"), "wk")
    row = [(fit.coef("qty"), float(fit.se[0]), fit.r2, fit.adj_r2)]
    out = spark.createDataFrame(row, "estimate double, std_error double, r2 double, adj_r2 double")
    return rounded(out, out.columns, S7)


@query(
    "J8_entity_and_period_effects",
    Q.union([WEEKLY_SQL], [Q.two_way("weekly", ModelSpec("two_way", "revenue", ["qty", "n_items"], entity="state", vce="cluster", cluster="state"), "wk", range(1, 53), S7)]),
)
def j8_two_way(spark, sf):
    panel = weekly_table(spark, sf, "state", "wk", "revenue", "qty", "n_items")
    spec = ModelSpec("two_way", "revenue", ["qty", "n_items"], entity="state", vce="cluster", cluster="state")
    return coef_row(spark, [linear.fit_two_way(panel, spec, "wk")])


TWO = (
    "c AS (SELECT count(*) AS n, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1, covar_pop(x2, y) AS s2, var_pop(y) AS sy FROM d)",
    "f AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2 FROM c)",
    "q AS (SELECT *, (sy - b1 * s1 - b2 * s2) / (n - 3.0) AS s2e FROM f)",
)
TWO_OUT = (
    f"SELECT 'poly' AS model_id, '{{a}}' AS term, {sig_sql('b1', 6)} AS estimate, {sig_sql('sqrt(s2e * s22 / det)', 6)} AS std_error FROM q "
    f"UNION ALL SELECT 'poly', '{{b}}', {sig_sql('b2', 6)}, {sig_sql('sqrt(s2e * s11 / det)', 6)} FROM q"
)


@query(
    "J9_polynomial",
    with_sql(WEEKLY_SQL, "d AS (SELECT revenue AS y, qty AS x1, qty * qty AS x2 FROM weekly)", *TWO) + TWO_OUT.format(a="qty", b="qty^2"),
)
def j9(spark, sf):
    spec = ModelSpec("poly", "revenue", poly("qty", 2), vce="classical")
    return coef_row(spark, [linear.fit(weekly_panel(spark, sf), spec)], ["qty", "qty^2"], 6)


@query(
    "J10_factor_interactions",
    f"SELECT 'by_flag' AS model_id, 'l_returnflag=' || l_returnflag || ':l_quantity' AS term, {sig_sql('regr_slope(l_extendedprice, l_quantity)', 6)} AS estimate FROM lineitem GROUP BY l_returnflag",
)
def j10(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    spec = ModelSpec("by_flag", "l_extendedprice", interact("l_returnflag", ["A", "N", "R"], "l_quantity"), entity="l_returnflag", vce="classical")
    return coef_row(spark, [fit_all(rows, [spec], cache=False)[0]], digits=6).filter(F.col("term") != "_cons").select("model_id", "term", "estimate")


@query(
    "J10_factor_by_factor",
    f"SELECT 'cells' AS model_id, 'l_returnflag=' || l_returnflag || ':l_linestatus=' || l_linestatus AS term, {sig_sql('avg(l_extendedprice)', 6)} AS estimate FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def j10_cells(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    terms = cross_factors("l_returnflag", ["A", "N", "R"], "l_linestatus", ["F", "O"])
    spec = ModelSpec("cells", "l_extendedprice", terms, constant=False, vce="classical")
    return coef_row(spark, [fit_all(rows, [spec], cache=False)[0]], digits=6).select("model_id", "term", "estimate")


def iv_fit(src, y, w, z, g="state", k_extra=""):
    return (
        f"m AS (SELECT count(*) AS n, count(DISTINCT {g}) AS g, sum({z} * {y}) / sum({z} * {w}) AS b, sum({z} * {w}) AS szw FROM {src})",
        f"s AS (SELECT {g}, sum({z} * ({y} - b * {w})) AS s FROM {src}, m GROUP BY 1)",
        "v AS (SELECT max(b) AS b, max(g) / (max(g) - 1.0) * sum(s * s) / max(szw * szw) AS v, max(n) AS n FROM s, m)",
    )


DIFFED = (
    "f AS (SELECT state, t, revenue - lag(revenue) OVER w AS d_revenue, price - lag(price) OVER w AS d_price, qty - lag(qty) OVER w AS d_qty, "
    "disc - lag(disc) OVER w AS d_disc, CAST(n_items - lag(n_items) OVER w AS DOUBLE) AS d_n_items FROM weekly WINDOW w AS (PARTITION BY state ORDER BY t))",
    "c0 AS (SELECT * FROM f WHERE d_revenue IS NOT NULL)",
    "d AS (" + demeaned("c0", ["d_revenue", "d_price", "d_qty", "d_disc", "d_n_items"]) + ")",
)


def differenced(spark, sf):
    p = weekly_panel(spark, sf).withColumn("n_items", F.col("n_items").cast("double"))
    return panel_features(Panel(p, "state", "t"), ["revenue", "price", "qty", "disc", "n_items"], 1)


@query(
    "J11_tsls_just_identified",
    with_sql(WEEKLY_SQL, *DIFFED, *iv_fit("d", "d_revenue", "d_price", "d_qty")) + one_sql("iv", "d_price", "b", "v", "v", 6),
)
def j11(spark, sf):
    fit = linear.tsls(differenced(spark, sf), "d_revenue", ["d_price"], ["d_qty"], name="iv", entity="state", vce="cluster", cluster="state")
    return coef_row(spark, [fit], ["d_price"], 6)


@query(
    "J12_tsls_over_identified",
    with_sql(
        WEEKLY_SQL,
        "c AS (SELECT covar_pop(qty, qty) AS s11, covar_pop(disc, disc) AS s22, covar_pop(qty, disc) AS s12, covar_pop(qty, price) AS s1, covar_pop(disc, price) AS s2 FROM weekly)",
        "p AS (SELECT (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS p1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS p2 FROM c)",
        "h AS (SELECT revenue AS y, price AS w, p1 * qty + p2 * disc AS hat FROM weekly, p)",
        "b AS (SELECT covar_pop(hat, y) / covar_pop(hat, w) AS b, avg(y) - covar_pop(hat, y) / covar_pop(hat, w) * avg(w) AS a, avg(hat) AS hm, covar_pop(hat, w) * count(*) AS den FROM h)",
        "v AS (SELECT max(b) AS b, sum((hat - hm) * (hat - hm) * (y - a - b * w) * (y - a - b * w)) / max(den * den) AS v FROM h, b)",
    )
    + one_sql("iv", "price", "b", "v", "v", 6),
)
def j12(spark, sf):
    fit = linear.tsls(weekly_panel(spark, sf), "revenue", ["price"], ["qty", "disc"], name="iv")
    return coef_row(spark, [fit], ["price"], 6)


@query(
    "J13_tsls_two_endogenous",
    with_sql(
        WEEKLY_SQL,
        *DIFFED,
        "c AS (SELECT sum(d_qty * d_price) AS a11, sum(d_qty * d_disc) AS a12, sum(d_n_items * d_price) AS a21, sum(d_n_items * d_disc) AS a22, sum(d_qty * d_revenue) AS c1, sum(d_n_items * d_revenue) AS c2 FROM d)",
        "s AS (SELECT (a22 * c1 - a12 * c2) / (a11 * a22 - a12 * a21) AS b1, (a11 * c2 - a21 * c1) / (a11 * a22 - a12 * a21) AS b2 FROM c)",
    )
    + f"SELECT 'iv2' AS model_id, 'd_price' AS term, {sig_sql('b1', 6)} AS estimate FROM s UNION ALL SELECT 'iv2', 'd_disc', {sig_sql('b2', 6)} FROM s",
)
def j13(spark, sf):
    fit = linear.tsls(differenced(spark, sf), "d_revenue", ["d_price", "d_disc"], ["d_qty", "d_n_items"], name="iv2", entity="state", vce="cluster", cluster="state")
    return coef_row(spark, [fit], ["d_price", "d_disc"], 6).select("model_id", "term", "estimate")


@query(
    "J14_residual_and_fitted",
    with_sql(
        WEEKLY_SQL,
        "r AS (SELECT state, t, CASE WHEN n_items > 3 THEN revenue END AS revenue, qty FROM weekly)",
        "k AS (SELECT * FROM r WHERE revenue IS NOT NULL)",
        "mm AS (SELECT state, avg(revenue) AS my, avg(qty) AS mx FROM k GROUP BY 1)",
        "b AS (SELECT sum((qty - mx) * (revenue - my)) / sum((qty - mx) * (qty - mx)) AS b FROM k JOIN mm USING (state))",
    )
    + f"SELECT state, t, {sig_sql('CASE WHEN revenue IS NOT NULL THEN my + b * (qty - mx) END', 7, '1e-3')} AS fit, "
    f"{sig_sql('revenue - my - b * (qty - mx)', 6, '1e-2')} AS res FROM r LEFT JOIN mm USING (state), b",
)
def j14(spark, sf):
    p = weekly_table(spark, sf, "state", "t", "revenue", "qty", "n_items").withColumn("revenue", F.when(F.col("n_items") > 3, F.col("revenue")))
    out, _ = linear.with_fit(p, ModelSpec("m", "revenue", ["qty"], entity="state"), "fit", "res")
    return out.select("state", "t", sig("fit", 7, 1e-3).alias("fit"), sig("res", 6, 1e-2).alias("res"))


def partialled(panel):
    """Measure projected on the instrument and controls, then cleared of the controls."""
    first = ModelSpec("first", "d_price", ["d_qty", "d_disc"], entity="state")
    hat = linear.fitted(panel, first, "hat")
    return linear.residualize(hat, ModelSpec("second", "hat", ["d_disc"], entity="state"), "hat_resid")


@query(
    "J15_projection_partialling_out",
    with_sql(
        WEEKLY_SQL,
        *DIFFED,
        "dt AS (SELECT state, t, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY state) AS {c}" for c in ("d_price", "d_qty", "d_disc")) + " FROM c0)",
        "a AS (SELECT sum(d_qty * d_disc) / sum(d_disc * d_disc) AS a FROM dt)",
        "z AS (SELECT state, t, d_price, d_qty - a * d_disc AS zz FROM dt, a)",
        "p AS (SELECT sum(zz * d_price) / sum(zz * zz) AS p FROM z)",
        "fr AS (SELECT state, t, p * zz AS r FROM z, p)",
        "al AS (SELECT weekly.state, weekly.t, r FROM weekly LEFT JOIN fr USING (state, t))",
    )
    + f"SELECT state, t, {sig_sql('lag(r, 1) OVER (PARTITION BY state ORDER BY t)', 6, '1e-2')} AS hat_resid_m1, {sig_sql('lag(r, 2) OVER (PARTITION BY state ORDER BY t)', 6, '1e-2')} AS hat_resid_m2 FROM al",
)
def j15(spark, sf):
    out = partialled(materialize(differenced(spark, sf), "diffs")).select("state", "t", "hat_resid")
    out = lag_by(Panel(out, "state", "t"), ["hat_resid"], [1, 2])
    return out.select("state", "t", sig("hat_resid_m1", 6, 1e-2).alias("hat_resid_m1"), sig("hat_resid_m2", 6, 1e-2).alias("hat_resid_m2"))


@query(
    "J16_single_wald",
    with_sql(WEEKLY_SQL, *DIFFED, *fe_fit("d", "d_price", "d_qty"))
    + f"SELECT 'd_qty' AS test, {sig_sql('b * b / v', 6)} AS statistic, 1 AS df1, CAST((SELECT g FROM m) - 1 AS DOUBLE) AS df2 FROM v",
)
def j16(spark, sf):
    spec = ModelSpec("first", "d_price", ["d_qty"], entity="state", vce="cluster", cluster="state")
    t = wald.test_term(linear.fit(differenced(spark, sf), spec), "d_qty")
    return wald.tests_table(spark, [t]).select("test", sig("statistic", 6).alias("statistic"), "df1", "df2")


@query(
    "J17_joint_wald",
    with_sql(WEEKLY_SQL, "d AS (SELECT revenue AS y, qty AS x1, qty * qty AS x2 FROM weekly)", *TWO)
    + f"SELECT 'qty qty^2' AS test, {sig_sql('((b1 * s1 + b2 * s2) / 2) / ((sy - b1 * s1 - b2 * s2) / (n - 3.0))', 6)} AS statistic, 2 AS df1, CAST(n - 3 AS DOUBLE) AS df2 FROM q",
)
def j17(spark, sf):
    fit = linear.fit(weekly_panel(spark, sf), ModelSpec("poly", "revenue", poly("qty", 2), vce="classical"))
    t = wald.test_joint(fit, ["qty", "qty^2"])
    return wald.tests_table(spark, [t]).select("test", sig("statistic", 6).alias("statistic"), "df1", "df2")


LEVELS_SQL = with_sql(
    "r AS (SELECT l_suppkey AS k, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_discount AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS v FROM lineitem)",
    "a AS (SELECT k, count(*) AS n, avg(v) AS vm, regr_sxx(x, v) AS svv, regr_slope(x, v) AS gx, regr_intercept(x, v) AS hx FROM r GROUP BY 1)",
    "t AS (SELECT r.*, x - hx - gx * v AS xt, svv FROM r JOIN a USING (k))",
    "c AS (SELECT sum(xt * y) / sum(xt * xt) AS b, sum(xt * xt) AS sxx, count(*) AS n FROM t)",
    "e AS (SELECT t.k, v, y - b * x AS e, b, sxx, c.n FROM t, c)",
    "g AS (SELECT k, regr_slope(e, v) AS slope, regr_intercept(e, v) AS icpt FROM e GROUP BY 1)",
    "s AS (SELECT sum(pow(e - icpt - slope * v, 2)) / (max(n) - 2.0 * (SELECT count(*) FROM a) - 1) AS s2, max(b) AS b, max(sxx) AS sxx FROM e JOIN g USING (k))",
)


@query(
    "J10_slopes_by_level",
    LEVELS_SQL
    + f"SELECT k AS level, 'l_quantity' AS term, {sig_sql('slope', 6)} AS estimate, {sig_sql('sqrt(s2 * (1 / svv + gx * gx / sxx))', 6)} AS std_error FROM g JOIN a USING (k), s "
    f"UNION ALL SELECT k, '_cons', {sig_sql('icpt', 6)}, {sig_sql('sqrt(s2 * (1.0 / n + vm * vm / svv + hx * hx / sxx))', 6)} FROM g JOIN a USING (k), s "
    f"UNION ALL SELECT NULL, 'l_discount', {sig_sql('b', 6)}, {sig_sql('sqrt(s2 / sxx)', 6)} FROM s",
)
def j10_levels(spark, sf):
    """Price on discount, with a level and a slope in quantity of each supplier; the suppliers are read from the data."""
    items = table(spark, sf, "lineitem")
    spec = ModelSpec("by_supplier", "l_extendedprice", ["l_discount"], vce="classical")
    fit = factors.fit_levels(items, spec, "l_suppkey", ["l_quantity"])
    levels = fit.levels.select(F.col("l_suppkey").alias("level"), "term", "estimate", "std_error")
    common = coefficients(spark, [fit.common]).select(F.lit(None).cast(levels.schema["level"].dataType).alias("level"), "term", "estimate", "std_error")
    return levels.unionByName(common).select("level", "term", sig("estimate", 6).alias("estimate"), sig("std_error", 6).alias("std_error"))


@query(
    "J18_equality_test",
    with_sql(
        WEEKLY_SQL,
        *DIFFED,
        "m AS (SELECT count(DISTINCT state) * 2.0 AS g, sum(d_qty * d_revenue) / sum(d_qty * d_price) AS b1, sum(d_qty * d_price) AS w1, sum(d_qty * d_revenue) / sum(d_qty * d_disc) AS b2, sum(d_qty * d_disc) AS w2 FROM d)",
        "s AS (SELECT state, sum(d_qty * (d_revenue - b1 * d_price)) AS s1, sum(d_qty * (d_revenue - b2 * d_disc)) AS s2 FROM d, m GROUP BY 1)",
        "v AS (SELECT max(b1) AS b1, max(b2) AS b2, max(g) / (max(g) - 1) * (sum(s1 * s1) / max(w1 * w1) + sum(s2 * s2) / max(w2 * w2)) AS v FROM s, m)",
    )
    + f"SELECT 'number=1:both = number=2:both' AS test, {sig_sql('(b1 - b2) * (b1 - b2) / v', 6)} AS statistic, 1 AS df1 FROM v",
)
def j18(spark, sf):
    _, t = G.equality_test(differenced(spark, sf), "d_revenue", ("d_price", "d_disc"), "d_qty", [], "state")
    return wald.tests_table(spark, [t]).select("test", sig("statistic", 6).alias("statistic"), "df1")


# One endogenous regressor, two instruments: first stage (h, v), augmented regression (a; s is v net of w), two-stage residual u, spare instrument r.
IV_TESTS = (
    "c AS (SELECT state, " + ", ".join(f"{c} - avg({c}) OVER () AS {n}" for c, n in (("revenue", "y"), ("price", "w"), ("qty", "z1"), ("disc", "z2"))) + " FROM weekly)",
    "p AS (SELECT count(*) AS n, sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS d, sum(z1 * w) AS p1, sum(z2 * w) AS p2 FROM c)",
    "k AS (SELECT *, (d * p1 - b * p2) / (a * d - b * b) AS k1, (a * p2 - b * p1) / (a * d - b * b) AS k2 FROM p)",
    "f AS (SELECT c.*, k1 * z1 + k2 * z2 AS h, w - k1 * z1 - k2 * z2 AS v FROM c, k)",
    "g AS (SELECT sum(h * y) / sum(h * h) AS beta, sum(v * y) / sum(v * v) - sum(h * y) / sum(h * h) AS gamma, sum(v * v) / sum(w * w) AS on_w, sum(z2 * h) / sum(h * h) AS on_h FROM f)",
    "e AS (SELECT f.*, y - beta * w AS u, y - beta * w - gamma * v AS a, v - on_w * w AS s, z2 - on_h * h AS r, gamma FROM f, g)",
)


def iv_tests_sql(rows):
    parts = [f"SELECT '{t}' AS test, {sig_sql(s, 6)} AS statistic, {a} AS df1, {b} AS df2 FROM {src}" for t, s, a, b, src in rows]
    return with_sql(WEEKLY_SQL, *IV_TESTS) + " UNION ALL ".join(parts)


FREE = "CAST(max(n) - 3 AS DOUBLE)"


@query(
    "J19_iv_diagnostics",
    iv_tests_sql(
        [
            ("weak_instruments:price", "(max(k1 * p1 + k2 * p2) / 2) / (sum(v * v) / (max(n) - 3.0))", 2, FREE, "f, k"),
            ("wu_hausman", "max(gamma * gamma) * sum(s * s) / (sum(e.a * e.a) / (max(n) - 3.0))", 1, FREE, "e, k"),
            (
                "sargan",
                "max(n) * (max(d) * pow(sum(z1 * u), 2) - 2 * max(b) * sum(z1 * u) * sum(z2 * u) + max(k.a) * pow(sum(z2 * u), 2)) / max(k.a * d - b * b) / sum(u * u)",
                1, "NULL", "e, k",
            ),
        ]
    ),
)
def j19(spark, sf):
    fit = linear.tsls(weekly_panel(spark, sf), "revenue", ["price"], ["qty", "disc"], name="iv")
    return _tests(spark, wald.iv_diagnostics(fit))


def _tests(spark, tests):
    return wald.tests_table(spark, tests).select("test", sig("statistic", 6).alias("statistic"), "df1", "df2")


@query(
    "J19_robust_iv_diagnostics",
    iv_tests_sql(
        [
            (
                "weak_instruments:price",
                "(max(n) - 3.0) / (2 * max(n)) * (sum(v * v * z2 * z2) * max(p1 * p1) - 2 * sum(v * v * z1 * z2) * max(p1 * p2) + sum(v * v * z1 * z1) * max(p2 * p2)) / (sum(v * v * z1 * z1) * sum(v * v * z2 * z2) - pow(sum(v * v * z1 * z2), 2))",
                2, FREE, "f, k",
            ),
            ("endogeneity", "(max(n) - 3.0) / max(n) * max(gamma * gamma) * pow(sum(s * s), 2) / sum(s * s * e.a * e.a)", 1, FREE, "e, k"),
            ("overidentification_score", "pow(sum(r * u), 2) / sum(r * r * u * u)", 1, "NULL", "e"),
        ]
    ),
)
def j19_robust(spark, sf):
    spec = ModelSpec("iv", "revenue", (), ["price"], ["qty", "disc"], vce="hc1")
    return _tests(spark, wald.robust_iv_diagnostics(weekly_panel(spark, sf), spec)[1])


CLUSTER_TESTS = (
    "cs AS (SELECT state, sum(v * z1) AS q1, sum(v * z2) AS q2, sum(s * e.a) AS q3, sum(r * u) AS q4 FROM e GROUP BY 1)",
    "ct AS (SELECT count(*) AS groups, sum(q1 * q1) AS m11, sum(q1 * q2) AS m12, sum(q2 * q2) AS m22, sum(q3 * q3) AS m33, pow(sum(q4), 2) / sum(q4 * q4) AS score FROM cs)",
    "cn AS (SELECT ct.*, p1, p2, n, (groups - 1.0) / groups * (n - 3.0) / (n - 1.0) AS small FROM ct, k)",
)


@query(
    "J19_clustered_iv_diagnostics",
    with_sql(WEEKLY_SQL, *IV_TESTS, *CLUSTER_TESTS)
    + f"SELECT 'weak_instruments:price' AS test, {sig_sql('small / 2 * (m22 * p1 * p1 - 2 * m12 * p1 * p2 + m11 * p2 * p2) / (m11 * m22 - m12 * m12)', 6)} AS statistic, 2 AS df1, CAST(groups - 1 AS DOUBLE) AS df2 FROM cn "
    f"UNION ALL SELECT 'endogeneity', {sig_sql('max(small) * max(gamma * gamma) * pow(sum(s * s), 2) / max(m33)', 6)}, 1, CAST(max(groups) - 1 AS DOUBLE) FROM e, cn "
    f"UNION ALL SELECT 'overidentification_score', {sig_sql('score', 6)}, 1, NULL FROM cn",
)
def j19_clustered(spark, sf):
    spec = ModelSpec("iv", "revenue", (), ["price"], ["qty", "disc"], vce="cluster", cluster="state")
    return _tests(spark, wald.robust_iv_diagnostics(weekly_panel(spark, sf), spec)[1])


@query(
    "J19_first_stage_f",
    with_sql(WEEKLY_SQL, *simple(y="price"), "v AS (SELECT max(slope) AS b, sum(err * err) / (max(n) - 2.0) / max(sxx) AS v, max(n) AS n FROM e)")
    + f"SELECT 'weak_instruments:price' AS test, {sig_sql('b * b / v', 6)} AS statistic, 1 AS df1, CAST(n - 2 AS DOUBLE) AS df2 FROM v",
)
def j19_first(spark, sf):
    fit = linear.tsls(weekly_panel(spark, sf), "revenue", ["price"], ["qty"], name="iv")
    out = wald.tests_table(spark, wald.iv_diagnostics(fit)).filter(F.col("test") == "weak_instruments:price")
    return out.select("test", sig("statistic", 6).alias("statistic"), "df1", "df2")


def fe_slopes(pairs):
    """UNION of within slopes: (model, term, numerator instrument, regressor)."""
    return " UNION ALL ".join(
        f"SELECT '{m}' AS model_id, '{w}' AS term, {sig_sql(f'sum({z} * d_revenue) / sum({z} * {w})', 6)} AS estimate FROM d" for m, w, z in pairs
    )


@query(
    "J20_attenuation_comparison",
    with_sql(WEEKLY_SQL, *DIFFED)
    + fe_slopes([("ols", "d_price", "d_price"), ("iv_instrument", "d_price", "d_n_items"), ("iv_other_measure", "d_price", "d_qty")]),
)
def j20(spark, sf):
    specs = G.attenuation_specs("d_revenue", "d_price", "d_qty", "d_n_items", [], "state")
    return coef_row(spark, G.run_grid(differenced(spark, sf), specs).fits, ["d_price"], 6).select("model_id", "term", "estimate")


LASSO_X = [f"qty_m{k}" for k in (1, 2, 3, 4)]


def lag_data(spark, sf):
    p = lag_by(Panel(weekly_panel(spark, sf).select("state", "t", "revenue", "qty"), "state", "t"), ["qty"], [1, 2, 3, 4])
    return materialize(lasso.standardize(p, "revenue", LASSO_X), "lasso")


@query(
    "J21_lasso_one_regressor",
    with_sql(
        WEEKLY_SQL,
        "c AS (SELECT count(*) AS n, avg(qty) AS mx, stddev_samp(qty) AS sd, avg(revenue) AS my FROM weekly)",
        "z AS (SELECT (qty - mx) / sd AS x, revenue - my AS y, n FROM weekly, c)",
        "g AS (SELECT sum(x * y) / sqrt(sum(x * x) / max(n)) / max(n) AS c, sqrt(sum(x * x) / max(n)) AS s FROM z)",
        "l AS (SELECT i + 1 AS step, abs(c) * exp(ln(0.0001) * i / 99.0) AS lam, c, s FROM g, (SELECT unnest(range(100)) AS i))",
    )
    + f"SELECT CAST(step AS INTEGER) AS step, {sig_sql('lam', 6)} AS lambda, {sig_sql('sign(c) * greatest(abs(c) - lam, 0) / s', 6, '1e-2')} AS estimate FROM l",
)
def j21_one(spark, sf):
    data = lasso.standardize(weekly_panel(spark, sf).select("revenue", "qty"), "revenue", ["qty"])
    out = lasso.lasso_path(data, "revenue", ["qty"]).table(spark)
    return out.select("step", sig("lambda", 6).alias("lambda"), sig("estimate", 6, 1e-2).alias("estimate"))


LAG_SQL = [
    WEEKLY_SQL,
    "lags AS (SELECT state, t, revenue, " + ", ".join(f"lag(qty, {k}) OVER (PARTITION BY state ORDER BY t) AS qty_m{k}" for k in (1, 2, 3, 4)) + " FROM weekly)",
    Z.standardized("z", "lags", "revenue", LASSO_X, ["state", "t"]),
    "zf AS (SELECT *, (t * 7 + length(state)) % 10 AS fold FROM z)",
]


@query("J21_lasso_path", Z.path_sql(LAG_SQL, "z", "revenue", LASSO_X))
def j21(spark, sf):
    out = lasso.lasso_path(lag_data(spark, sf), "revenue", LASSO_X).table(spark)
    return out.select("step", sig("lambda", 6).alias("lambda"), "term", sig("estimate", 5, 1e-6).alias("estimate"))


@query("J22_cross_validated_lasso", Z.selected_sql(LAG_SQL, "zf", "revenue", LASSO_X, 10))
def j22(spark, sf):
    """Folds are dealt by a column, so that SQL can deal them too."""
    fold = F.pmod(F.col("t") * 7 + F.length("state"), F.lit(10)).cast("int")
    return selected(lasso.cv_lasso(lag_data(spark, sf), "revenue", LASSO_X, ["state", "t"], fold=fold).selected(spark))


def selected(rows):
    real = {"lambda_1se": 6, "estimate": 5, "lambda_min": 6, "estimate_min": 5}
    return rows.withColumns({c: sig(c, d, 1e-6) for c, d in real.items()})


MEASURES = ["d_price", "d_qty", "d_disc"]


MODEL_SQL = [
    WEEKLY_SQL,
    "m0 AS (SELECT state, t, revenue, price, qty, disc, n_items, CASE WHEN n_items > 8 THEN 1 ELSE 0 END AS emerg, CASE WHEN disc > 0.3 THEN 1 ELSE 0 END AS gath FROM weekly)",
    Q.features("f", "m0", Q.panel_features(["revenue", "price", "qty", "disc", "n_items", "emerg", "gath"], 5), "state", "t"),
]


def model_panel(spark, sf):
    """Weekly panel with two 0/1 policy columns and all lags, written once for the fits."""
    p = weekly_panel(spark, sf).select(
        "state",
        "t",
        "revenue",
        "price",
        "qty",
        "disc",
        F.col("n_items").cast("double").alias("n_items"),
        (F.col("n_items") > 8).cast("int").alias("emerg"),
        (F.col("disc") > 0.3).cast("int").alias("gath"),
    )
    return materialize(panel_features(Panel(p, "state", "t"), ["revenue", "price", "qty", "disc", "n_items", "emerg", "gath"], 5), "grid")


GRID_SPECS = [
    *G.first_stage_specs(MEASURES, "d_n_items", ["emerg", "gath", "d_revenue_m1"], "state", "t"),
    *G.second_stage_specs("d_revenue", MEASURES, "d_n_items", ["emerg", "gath"], [1, 2, 3, 4], "state", "t"),
    *G.two_lag_specs("d_revenue", MEASURES, "d_n_items", ["emerg", "gath"], (1, 3), "state"),
]


@query("J23_model_grid", Q.union(MODEL_SQL, Q.model_rows("f", GRID_SPECS, digits=5)))
def j23(spark, sf):
    out = G.run_grid(model_panel(spark, sf), GRID_SPECS).coefficients
    return out.select("model_id", "term", sig("estimate", 5).alias("estimate"), sig("std_error", 5).alias("std_error"))


def _grid_sql():
    out = []
    for k in (1, 2):
        for m in MEASURES:
            w, z = f"{m}_m{k}", f"d_n_items_m{k}"
            cols = ["d_revenue", w, z]
            d = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY state) AS {c}" for c in cols)
            ok = " AND ".join(f"{c} IS NOT NULL" for c in cols)
            out.append(
                f"SELECT 'b_{m}_m{k}' AS model_id, 'mobility_m{k}' AS role, {sig_sql(f'sum({z} * d_revenue) / sum({z} * {w})', 6)} AS estimate "
                f"FROM (SELECT {d} FROM lg WHERE {ok})"
            )
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}_m{k}" for c in [*MEASURES, "d_n_items"] for k in (1, 2))
    return with_sql(WEEKLY_SQL, DIFFED[0], f"lg AS (SELECT state, d_revenue, {lags} FROM f WINDOW w AS (PARTITION BY state ORDER BY t))") + " UNION ALL ".join(out)


@query("J23_grid_entity_effects", _grid_sql())
def j23_b(spark, sf):
    specs = G.second_stage_specs("d_revenue", MEASURES, "d_n_items", ["emerg", "gath"], [1, 2], "state", "t")
    out = G.run_grid(model_panel(spark, sf), specs).coefficients
    return out.filter(F.col("model_id").startswith("b_") & F.col("role").startswith("mobility")).select("model_id", "role", sig("estimate", 6).alias("estimate"))


TABLE_SPECS = G.first_stage_specs(["d_price", "d_qty"], "d_n_items", ["emerg", "d_revenue_m1"], "state", "t")
TABLE_ORDER, TABLE_LABELS = ["d_n_items", "emerg", "d_revenue_m1", "_cons"], {"d_n_items": "Instrument", "_cons": "Constant"}


def _table_sql():
    rows = Q.union([*MODEL_SQL, Q.CRITICAL], Q.table_rows("f", TABLE_SPECS, "t", TABLE_ORDER, "f", TABLE_LABELS))
    cells = ", ".join(f"max(cell) FILTER (model_id = '{s.name}') AS \"{s.name}\"" for s in TABLE_SPECS)
    return f"SELECT row, label, {cells} FROM ({rows}) GROUP BY row, label"


@query("J24_coefficient_table", _table_sql())
def j24(spark, sf):
    grid = G.run_grid(model_panel(spark, sf), TABLE_SPECS)
    return coef_table(grid.coefficients, grid.models, TABLE_ORDER, [s.name for s in TABLE_SPECS], labels=TABLE_LABELS)


def _cells(y):
    b, v = f"b_{y}", f"v_{y}"
    return (
        f"{b} AS (SELECT count(*) AS n, regr_sxx({y}, qty) AS sxx, regr_slope({y}, qty) AS b, regr_intercept({y}, qty) AS a, regr_r2({y}, qty) AS r2 FROM weekly), "
        f"{v} AS (SELECT '{y}' AS m, max(n) AS n, max(b) AS b, sqrt(sum(pow({y} - a - b * qty, 2)) / (max(n) - 2.0) / max(sxx)) AS se, max(r2) AS r2 FROM weekly, {b}), "
        f"t_{y} AS (SELECT unnest([0, 1, 2, 3, 4]) AS row, unnest(['qty', '', 'N', 'R2', 'Adj. R2']) AS label, "
        f"unnest([format('{{:,.3f}}', b) || '***', '(' || format('{{:,.3f}}', se) || ')', format('{{:,}}', n), format('{{:.3f}}', r2), format('{{:.3f}}', 1 - (1 - r2) * (n - 1.0) / (n - 2.0))]) AS cell FROM {v})"
    )


TABLE_SQL = with_sql(WEEKLY_SQL, _cells("revenue"), _cells("price"))


def plain_table(spark, sf):
    specs = [ModelSpec(y, y, ["qty"], vce="classical") for y in ("revenue", "price")]
    grid = G.run_grid(weekly_panel(spark, sf), specs)
    return coef_table(grid.coefficients, grid.models, ["qty"], ["revenue", "price"])


@query(
    "J24_table_cells",
    TABLE_SQL + "SELECT CAST(row AS INTEGER) AS row, label, a.cell AS revenue, b.cell AS price FROM t_revenue a JOIN t_price b USING (row, label)",
)
def j24_cells(spark, sf):
    return plain_table(spark, sf)


@query(
    "A12_table_lines",
    TABLE_SQL + "SELECT label || ' & ' || a.cell || ' & ' || b.cell || ' \\\\' AS value FROM t_revenue a JOIN t_price b USING (row, label)",
)
def a12_lines(spark, sf):
    path = scratch_path(spark, "tables")
    export_table(plain_table(spark, sf), path, order=["row"])
    return spark.read.text(path)


@query(
    "J25_tidy_one_term",
    with_sql(WEEKLY_SQL)
    + f"SELECT 'y' || yr AS model_id, 'qty' AS term, {sig_sql('regr_slope(revenue, qty)', S7)} AS estimate FROM weekly GROUP BY yr",
)
def j25(spark, sf):
    p = weekly_table(spark, sf, "yr", "revenue", "qty")
    years = sorted(r["yr"] for r in p.select("yr").distinct().collect())
    specs = [ModelSpec(f"y{y}", ("revenue", F.when(F.col("yr") == y, F.col("revenue"))), ["qty"], vce="classical") for y in years]
    # The outcome's label is shared, so each year's expression is its own column.
    specs = [ModelSpec(s.name, (s.name, s.y[1]), ["qty"], vce="classical") for s in specs]
    out = bygroup.tidy_term(G.run_grid(p, specs).coefficients, "qty")
    return out.select("model_id", "term", sig("estimate", S7).alias("estimate"))


@query(
    "J26_standardize",
    with_sql(WEEKLY_SQL)
    + f"SELECT state, t, {sig_sql('revenue - avg(revenue) OVER ()', 7, '1e-2')} AS revenue, {sig_sql('(qty - avg(qty) OVER ()) / stddev_samp(qty) OVER ()', 7, '1e-6')} AS qty FROM weekly",
)
def j26(spark, sf):
    out = lasso.standardize(weekly_panel(spark, sf).select("state", "t", "revenue", "qty"), "revenue", ["qty"])
    return out.select("state", "t", sig("revenue", 7, 1e-2).alias("revenue"), sig("qty", 7, 1e-6).alias("qty"))


CORR = ["price", "qty", "disc"]


@query(
    "J27_correlation_matrix",
    with_sql(WEEKLY_SQL)
    + " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, {sig_sql(f'corr({a}, {b})')} AS corr FROM weekly" for i, a in enumerate(CORR) for b in CORR[i:]),
)
def j27(spark, sf):
    return rounded(corr_matrix(weekly_panel(spark, sf), CORR), ["corr"])


@query(
    "J28_iv_design",
    with_sql(WEEKLY_SQL)
    + " UNION ALL ".join(
        f"SELECT 'd:{m}' AS model_id, '{w}' AS term, {sig_sql(e, 6)} AS estimate FROM weekly"
        for m, w, e in (
            ("first_stage", "qty", "regr_slope(price, qty)"),
            ("reduced_form", "qty", "regr_slope(revenue, qty)"),
            ("endogenous", "price", "regr_slope(revenue, price)"),
            ("iv", "price", "covar_pop(qty, revenue) / covar_pop(qty, price)"),
        )
    ),
)
def j28(spark, sf):
    specs = G.iv_design("d", "revenue", "price", "qty")
    out = coef_row(spark, G.run_grid(weekly_panel(spark, sf), specs).fits, digits=6)
    return out.filter(F.col("term") != "_cons").select("model_id", "term", "estimate")


@query(
    "J29_source_agreement",
    with_sql(WEEKLY_SQL, *GROUPED)
    + f"SELECT state, {sig_sql('b', S7)} AS estimate, {sig_sql('sqrt(v)', S7)} AS std_error FROM v UNION ALL "
    f"SELECT 'pooled', {sig_sql('(SELECT regr_slope(revenue, qty) FROM weekly)', S7)}, "
    f"(WITH {', '.join(simple())} SELECT {sig_sql('sqrt(' + HC2 + ')', S7)} FROM e)",
)
def j29(spark, sf):
    pooled, per_state = bygroup.agreement(weekly_table(spark, sf, "state", "revenue", "qty"), "state", "revenue", "qty")
    a = per_state.select("state", "estimate", "std_error")
    b = coefficients(spark, [pooled]).filter(F.col("term") == "qty").select(F.lit("pooled").alias("state"), "estimate", "std_error")
    return rounded(a.unionByName(b), ["estimate", "std_error"], S7)


@query(
    "J30_collinear_terms",
    with_sql(WEEKLY_SQL)
    + f"SELECT 'm' AS model_id, 'qty' AS term, {sig_sql('regr_slope(revenue, qty)', S7)} AS estimate FROM weekly "
    f"UNION ALL SELECT 'm', 'twice', NULL UNION ALL SELECT 'm', '_cons', {sig_sql('regr_intercept(revenue, qty)', 6)} FROM weekly",
)
def j30(spark, sf):
    spec = ModelSpec("m", "revenue", ["qty", ("twice", 2 * F.col("qty") + 1)], vce="classical")
    out = coefficients(spark, [linear.fit(weekly_panel(spark, sf), spec)])
    est = F.when(F.col("term") == "_cons", sig("estimate", 6)).otherwise(sig("estimate", S7))
    return out.select("model_id", "term", est.alias("estimate"))
