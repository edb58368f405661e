"""The minimum slice end to end: scan, join, roll-up, windows, estimator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.models import linear
from panelspark.models.spec import ModelSpec
from panelspark.operators.panel import Panel, panel_features, zscore_panel
from panelspark.session import materialize

from .common import WEEKLY_SQL, query, sig, sig_sql, weekly_panel, with_sql

SQL = with_sql(
    WEEKLY_SQL,
    "z AS (SELECT state, t, revenue, (price - avg(price) OVER (PARTITION BY state)) / stddev_samp(price) OVER (PARTITION BY state) AS mobility, "
    "(qty - avg(qty) OVER (PARTITION BY state)) / stddev_samp(qty) OVER (PARTITION BY state) AS rain FROM weekly)",
    "f AS (SELECT state, revenue - lag(revenue) OVER w AS dy, mobility - lag(mobility) OVER w AS dm, rain - lag(rain) OVER w AS dr FROM z WINDOW w AS (PARTITION BY state ORDER BY t))",
    "c AS (SELECT * FROM f WHERE dy IS NOT NULL AND dm IS NOT NULL AND dr IS NOT NULL)",
    "d AS (SELECT state, dy - avg(dy) OVER (PARTITION BY state) AS dy, dm - avg(dm) OVER (PARTITION BY state) AS dm, dr - avg(dr) OVER (PARTITION BY state) AS dr FROM c)",
    "m AS (SELECT count(*) AS n, count(DISTINCT state) AS g, sum(dr * dy) / sum(dr * dm) AS b, sum(dr * dm) AS s FROM d)",
    "u AS (SELECT state, sum(dr * (dy - b * dm)) AS u FROM d, m GROUP BY 1)",
) + (
    f"SELECT max(n)::BIGINT AS n, {sig_sql('max(b)', 6)} AS beta, {sig_sql('sqrt(max(g) / (max(g) - 1.0) * sum(u * u)) / abs(max(s))', 6)} AS se FROM u, m"
)


@query("weekly_effect", SQL)
def weekly_effect(spark: SparkSession, sf: str) -> DataFrame:
    """One row (n, beta, se): the effect of a one-sd rise of the instrumented measure."""
    panel = zscore_panel(Panel(weekly_panel(spark, sf), "state", "t"), {"price": "mobility", "qty": "rain"})
    panel = panel.select("state", "t", "revenue", "mobility", "rain")
    panel = materialize(panel_features(Panel(panel, "state", "t"), ["revenue", "mobility", "rain"], 1), "flagship")
    spec = ModelSpec("effect", "d_revenue", (), ["d_mobility"], ["d_rain"], entity="state", vce="cluster", cluster="state")
    fit = linear.fit(panel, spec)
    out = spark.createDataFrame(
        [(fit.n, fit.coef("d_mobility"), fit.std_error("d_mobility"))], "n long, beta double, se double"
    )
    return out.select("n", sig("beta", 6).alias("beta"), sig("se", 6).alias("se"))
