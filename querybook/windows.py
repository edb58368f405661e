"""W: ordered panel functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from panelspark.functions.scalars import clock_to_date, safe_div, week52
from panelspark.operators import panel as P
from panelspark.operators.aggregates import argmin_rows, row_number_in
from panelspark.operators.joins import first_date_when
from panelspark.operators.reshape import calendar

from .common import DAILY_SQL, USERS_SQL, WEEKLY_SQL, daily_types, daily_users, event_days, query, rounded, sig, sig_sql, table, week_sql, weekly_panel, weekly_table, with_sql

OVER = "OVER (PARTITION BY state ORDER BY t)"


def weekly(spark, sf, block=None):
    panel = weekly_panel(spark, sf) if block is None else weekly_table(spark, sf, "state", "t", "qty")
    return P.Panel(panel, "state", "t", block)


@query(
    "W1_lags",
    with_sql(WEEKLY_SQL) + "SELECT state, t, " + ", ".join(f"lag(qty, {k}) {OVER} AS qty_m{k}" for k in range(1, 6)) + " FROM weekly",
)
def w1(spark, sf):
    return P.lag_by(weekly(spark, sf), ["qty"], range(1, 6)).select("state", "t", *[f"qty_m{k}" for k in range(1, 6)])


@query(
    "W1_lags_in_blocks",
    with_sql(WEEKLY_SQL) + "SELECT state, t, " + ", ".join(f"lag(qty, {k}) {OVER} AS qty_m{k}" for k in range(1, 6)) + " FROM weekly",
)
def w1_blocks(spark, sf):
    return P.lag_by(weekly(spark, sf, block=16), ["qty"], range(1, 6)).select("state", "t", *[f"qty_m{k}" for k in range(1, 6)])


@query(
    "W1_calendar_lag",
    with_sql(USERS_SQL) + "SELECT a.user_id, a.date, a.v, b.v AS v_m2 FROM users a LEFT JOIN users b ON a.user_id = b.user_id AND a.date = b.date + 2",
)
def w1_calendar(spark, sf):
    return P.lag_calendar(P.Panel(daily_users(spark, sf), "user_id", "date"), ["v"], 2).select("user_id", "date", "v", "v_m2")


@query("W2_first_difference", with_sql(WEEKLY_SQL) + f"SELECT state, t, {sig_sql(f'revenue - lag(revenue) {OVER}')} AS d_revenue FROM weekly")
def w2(spark, sf):
    return P.difference(weekly(spark, sf), ["revenue"]).select("state", "t", sig("d_revenue").alias("d_revenue"))


@query("W3_log_difference", with_sql(WEEKLY_SQL) + f"SELECT state, t, {sig_sql(f'ln(revenue) - ln(lag(revenue) {OVER})')} AS d_log_revenue FROM weekly")
def w3(spark, sf):
    return P.log_difference(weekly(spark, sf), ["revenue"]).select("state", "t", sig("d_log_revenue").alias("d_log_revenue"))


@query(
    "W4_lagged_differences",
    with_sql(WEEKLY_SQL)
    + "SELECT state, t, " + ", ".join(sig_sql(f"(lag(price, {k}) {OVER} - lag(price, {k + 1}) {OVER}) / 100000") + f" AS d_price_m{k}" for k in (1, 2, 3)) + " FROM weekly",
)
def w4(spark, sf):
    out = P.lagged_differences(weekly(spark, sf), ["price"], [1, 2, 3], scale=100000.0)
    return out.select("state", "t", *[sig(f"d_price_m{k}").alias(f"d_price_m{k}") for k in (1, 2, 3)])


def _feature_sql(v, lags):
    def at(k):
        return v if k == 0 else f"lag({v}, {k}) {OVER}"

    def log(k):
        return f"(CASE WHEN ({at(k)}) > 0 THEN ln({at(k)}) END)"

    def r(x):
        return f"round({x}, 9) + 0.0"

    out = [f"{at(0)} - {at(1)} AS d_{v}", f"{r(f'{log(0)} - {log(1)}')} AS d_log_{v}"]
    for k in range(1, lags + 1):
        out.append(f"CAST({at(k)} AS DOUBLE) AS {v}_m{k}")
        out.append(f"{at(k)} - {at(k + 1)} AS d_{v}_m{k}")
        out.append(f"{r(f'{log(k)} - {log(k + 1)}')} AS d_log_{v}_m{k}")
    return out


FEATURE_VARS = ["revenue", "qty", "disc"]


@query(
    "W5_feature_generator",
    with_sql(WEEKLY_SQL) + "SELECT state, t, " + ", ".join(x for v in FEATURE_VARS for x in _feature_sql(v, 5)) + " FROM weekly",
)
def w5(spark, sf):
    base = weekly_panel(spark, sf).select("state", "t", *FEATURE_VARS)
    out = P.panel_features(P.Panel(base, "state", "t"), FEATURE_VARS, 5).drop(*FEATURE_VARS)
    return out.withColumns({c: F.round(c, 9) + 0.0 for c in out.columns if c.startswith("d_log_")})


def _change_sql(over):
    prev = f"lag(revenue) {over}"
    return f"SELECT state, t, {sig_sql(f'(revenue - {prev}) / {prev}')} AS pct, {sig_sql(f'ln(revenue) - ln({prev})')} AS log FROM weekly"


@query("W6_changes_per_entity", with_sql(WEEKLY_SQL) + _change_sql(OVER))
def w6(spark, sf):
    out = P.changes(weekly(spark, sf), {"revenue": ("pct", "log")})
    return out.select("state", "t", sig("pct").alias("pct"), sig("log").alias("log"))


@query("W6_changes_across_entities", with_sql(WEEKLY_SQL) + _change_sql("OVER (ORDER BY state, t)"))
def w6_across(spark, sf):
    panel = P.Panel(weekly_table(spark, sf, "state", "t", "revenue"), "state", "t")
    out = P.changes(panel, {"revenue": ("pct", "log")}, across_entities=True)
    return out.select("state", "t", sig("pct").alias("pct"), sig("log").alias("log"))


@query(
    "W7_chained_index",
    with_sql(
        DAILY_SQL,
        f"g AS (SELECT state, date, {week_sql('date')} AS wk, n / lag(n) OVER (PARTITION BY state ORDER BY date) - 1 AS g FROM daily)",
        "h AS (SELECT *, row_number() OVER w AS rn FROM g WINDOW w AS (PARTITION BY state, wk ORDER BY date))",
    )
    + f"SELECT state, date, {sig_sql('exp(sum(CASE WHEN rn = 1 THEN 0.0 ELSE ln(1 + g) END) OVER (PARTITION BY state, wk ORDER BY date)) - 1', 8, '1e-8')} AS idx FROM h",
)
def w7(spark, sf):
    d = P.Panel(daily_types(spark, sf), "state", "date")
    g = P.changes(d, {"n": ("g", "lg")}).withColumn("wk", week52("date"))
    out = P.chain_index(g, ["state", "wk"], ["date"], {"g": "idx"})
    return out.select("state", "date", sig("idx", 8, 1e-8).alias("idx"))


FULL_CALENDAR = (
    "u AS (SELECT DISTINCT user_id FROM events), c AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS DATE) AS date), "
    "full_cal AS (SELECT u.user_id, c.date, v FROM u CROSS JOIN c LEFT JOIN users ON users.user_id = u.user_id AND users.date = c.date)"
)


def full_calendar(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    spine = calendar(users, *event_days(spark, sf), "date")
    return spine.join(daily_users(spark, sf), ["user_id", "date"], "left").select("user_id", "date", "v")


FILL_SQL = with_sql(USERS_SQL, FULL_CALENDAR) + (
    "SELECT user_id, date, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM full_cal"
)


@query("W8_fill_forward", FILL_SQL)
def w8(spark, sf):
    return P.fill_forward(P.Panel(full_calendar(spark, sf), "user_id", "date"), ["v"])


@query("W8_fill_forward_in_blocks", FILL_SQL)
def w8_blocks(spark, sf):
    return P.fill_forward(P.Panel(full_calendar(spark, sf), "user_id", "date", block=7), ["v"])


@query(
    "W9_row_number",
    "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS number FROM orders",
)
def w9(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return row_number_in(o, ["o_custkey"], ["o_orderkey"], "number")


@query(
    "W10_group_zscore",
    with_sql(WEEKLY_SQL)
    + f"SELECT state, t, {sig_sql('(revenue - avg(revenue) OVER (PARTITION BY state)) / stddev_samp(revenue) OVER (PARTITION BY state)', 8, '1e-6')} AS z FROM weekly",
)
def w10(spark, sf):
    out = P.zscore_by(weekly_table(spark, sf, "state", "t", "revenue"), ["state"], {"revenue": "z"})
    return out.select("state", "t", sig("z", 8, 1e-6).alias("z"))


@query(
    "W10_panel_zscore",
    with_sql(WEEKLY_SQL)
    + f"SELECT state, t, {sig_sql('(revenue - avg(revenue) OVER (PARTITION BY state)) / stddev_samp(revenue) OVER (PARTITION BY state)', 8, '1e-6')} AS z FROM weekly",
)
def w10_panel(spark, sf):
    out = P.zscore_panel(weekly(spark, sf), {"revenue": "z"})
    return out.select("state", "t", sig("z", 8, 1e-6).alias("z"))


@query(
    "W11_global_zscore",
    f"SELECT o_orderkey, {sig_sql('(o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER ()', 8, '1e-6')} AS z FROM orders",
)
def w11(spark, sf):
    out = P.zscore(table(spark, sf, "orders"), {"o_totalprice": "z"})
    return out.select("o_orderkey", sig("z", 8, 1e-6).alias("z"))


@query("W12_dense_id", "SELECT c_custkey, c_name, CAST(dense_rank() OVER (ORDER BY c_name) AS INTEGER) AS id FROM customer")
def w12(spark, sf):
    return P.with_dense_id(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "id")


@query("W12_dense_id_by_ranges", "SELECT c_name, CAST(dense_rank() OVER (ORDER BY c_name) AS INTEGER) AS id FROM customer")
def w12_ranges(spark, sf):
    return P.dense_ids(table(spark, sf, "customer"), "c_name", "id")


@query(
    "W13_argmin_rows",
    "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS r FROM orders) WHERE r = 1",
)
def w13(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", clock_to_date("o_orderdate").alias("day"))
    return argmin_rows(o, ["o_custkey"], "day")


NATIONAL = (
    "nat AS (SELECT t, sum(qty) AS us_qty, sum(n_items)::DOUBLE AS us_items, sum(disc) AS us_disc FROM weekly GROUP BY 1), "
    "ss AS (SELECT state, t, disc / qty AS share, us_disc / us_qty AS frac, us_items, us_qty FROM weekly JOIN nat USING (t)), "
    "lg AS (SELECT *, lag(share) OVER w AS s0, lag(frac) OVER w AS f0, lag(us_items) OVER w AS i0, lag(us_qty) OVER w AS q0 FROM ss WINDOW w AS (PARTITION BY state ORDER BY t))"
)


def national_panel(spark, sf):
    p = weekly_table(spark, sf, "state", "t", "qty", "n_items", "disc")
    nat = p.groupBy("t").agg(
        F.sum("qty").alias("us_qty"), F.sum("n_items").cast("double").alias("us_items"), F.sum("disc").alias("us_disc")
    )
    return p.join(nat, ["t"]).select(
        "state", "t", safe_div("disc", "qty").alias("share"), safe_div("us_disc", "us_qty").alias("frac"), "us_items", "us_qty"
    )


@query(
    "W14_shift_share_fraction",
    with_sql(WEEKLY_SQL, NATIONAL)
    + f"SELECT state, t, {sig_sql('CASE WHEN frac = 0 AND f0 = 0 THEN 0.0 ELSE s0 * (frac - f0) / f0 + (1 - s0) * (f0 - frac) / (1 - f0) END', 5, '1e-6')} AS bartik FROM lg",
)
def w14(spark, sf):
    out = P.shift_share(P.Panel(national_panel(spark, sf), "state", "t"), "share", "frac", "bartik")
    return out.select("state", "t", sig("bartik", 5, 1e-6).alias("bartik"))


@query(
    "W15_shift_share_levels",
    with_sql(WEEKLY_SQL, NATIONAL)
    + f"SELECT state, t, {sig_sql('CASE WHEN s0 = 0 THEN (1 - s0) * (us_qty - q0) / q0 ELSE s0 * (us_items - i0) / i0 + (1 - s0) * (us_qty - q0) / q0 END', 7, '1e-8')} AS bartik FROM lg",
)
def w15(spark, sf):
    out = P.shift_share_levels(P.Panel(national_panel(spark, sf), "state", "t"), "share", "us_items", "us_qty", "bartik")
    return out.select("state", "t", sig("bartik", 7, 1e-8).alias("bartik"))


@query(
    "W16_step_panel",
    "WITH f AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' AND value > 60 THEN CAST(ts AS DATE) END) AS p, "
    "min(CASE WHEN event_type = 'signup' AND value > 60 THEN CAST(ts AS DATE) END) AS s FROM events GROUP BY 1), "
    "c AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS DATE) AS date) "
    "SELECT date, user_id, CAST(coalesce(date >= p, false) AS INTEGER) AS purchase, CAST(coalesce(date >= s, false) AS INTEGER) AS signup FROM f CROSS JOIN c",
)
def w16(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", clock_to_date("ts"))
    return P.step_panel(
        ev, "user_id", "event_type", "day", ["purchase", "signup"], *event_days(spark, sf), counts=F.col("value") > 60
    )


DELAY_SQL = (
    "WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), f AS (SELECT user_id, min(CASE WHEN event_type = 'error' THEN day END) AS fc, "
    "min(CASE WHEN event_type = 'view' THEN day END) AS fd FROM e GROUP BY 1), "
    "m AS (SELECT user_id, event_type, day, rank() OVER (PARTITION BY user_id, event_type ORDER BY day) AS r FROM e WHERE event_type IN ('purchase', 'signup') AND value > 20), "
    "x AS (SELECT user_id, day - fc AS a, day - fd AS b, day - DATE '2024-01-02' AS c, day - DATE '2024-01-05' AS d FROM m JOIN f USING (user_id) WHERE r = 1) "
)


def delays(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", clock_to_date("ts"))
    case = first_date_when(ev, "user_id", "day", F.col("event_type") == "error", "fc")
    death = first_date_when(ev, "user_id", "day", F.col("event_type") == "view", "fd")
    pol = ev.filter(F.col("event_type").isin("purchase", "signup") & (F.col("value") > 20)).select("user_id", "event_type", "day")
    pol = pol.join(case, ["user_id"]).join(death, ["user_id"])
    return P.delay_rows(pol, "user_id", "event_type", "day", "fc", "fd", date(2024, 1, 2), date(2024, 1, 5))


@query(
    "W17_delay_index",
    DELAY_SQL + "SELECT user_id, " + ", ".join(sig_sql(f"CASE WHEN count({c}) = count(*) THEN avg({c}) END") + f" AS {n}" for c, n in zip("abcd", P.DELAY_COLUMNS)) + " FROM x GROUP BY 1",
)
def w17(spark, sf):
    return rounded(P.delay_index(delays(spark, sf), "user_id"), P.DELAY_COLUMNS)


@query(
    "W18_demean",
    with_sql(WEEKLY_SQL)
    + f"SELECT state, t, {sig_sql('revenue - avg(revenue) OVER (PARTITION BY state)', 7, '1e-3')} AS revenue_dm, {sig_sql('qty - avg(qty) OVER (PARTITION BY state)', 7, '1e-6')} AS qty_dm FROM weekly",
)
def w18(spark, sf):
    out = P.demean(weekly_table(spark, sf, "state", "t", "revenue", "qty"), ["state"], ["revenue", "qty"])
    return out.select("state", "t", sig("revenue_dm", 7, 1e-3).alias("revenue_dm"), sig("qty_dm", 7, 1e-6).alias("qty_dm"))
