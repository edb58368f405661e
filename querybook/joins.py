"""C: checked joins, natural joins, lookups, interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.scalars import clock_to_date
from panelspark.models.linear import residualize
from panelspark.models.spec import ModelSpec
from panelspark.operators import joins
from panelspark.operators.panel import step_panel_long

from .common import DAILY_SQL, USERS_SQL, WEEKLY_SQL, daily_types, daily_users, event_days, query, sig, sig_sql, table, weekly_table, with_sql

KEYS = ["state", "yr", "wk"]


def even_odd(spark, sf):
    """Left table with the panel's early weeks, right table with its late weeks; both overlap."""
    p = weekly_table(spark, sf)
    left = p.filter(F.col("wk") <= 30).select(*KEYS, "revenue", "qty")
    right = p.filter(F.col("wk") >= 20).select(*KEYS, F.lit(-1.0).alias("qty"), "n_items")
    return left, right


HALVES = (
    "l AS (SELECT state, yr, wk, revenue, qty FROM weekly WHERE wk <= 30), "
    "r AS (SELECT state, yr, wk, n_items FROM weekly WHERE wk >= 20) "
)


@query(
    "C1_checked_join",
    "WITH a AS (SELECT doc_id, quality, CASE WHEN quality = 1 THEN doc_id END AS k FROM labels), "
    "b AS (SELECT DISTINCT k, coalesce(k, -1) AS tag FROM a) SELECT a.doc_id, a.k, a.quality, b.tag FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k",
)
def checked(spark, sf):
    left = table(spark, sf, "labels").select("doc_id", "quality", F.when(F.col("quality") == 1, F.col("doc_id")).alias("k"))
    right = left.select("k").distinct().select("k", F.coalesce("k", F.lit(-1)).alias("tag"), F.lit(0).alias("quality"))
    return joins.merge(left, right, ["k"], card="m:1", keep="matched")


@query("C2_full_outer", with_sql(WEEKLY_SQL) [:-1] + ", " + HALVES + "SELECT state, yr, wk, revenue, qty, n_items FROM l FULL JOIN r USING (state, yr, wk)")
def full_outer(spark, sf):
    return joins.merge(*even_odd(spark, sf), KEYS, keep="all")


@query("C3_matched_only", with_sql(WEEKLY_SQL)[:-1] + ", " + HALVES + "SELECT state, yr, wk, revenue, qty, n_items FROM l JOIN r USING (state, yr, wk)")
def matched(spark, sf):
    return joins.merge(*even_odd(spark, sf), KEYS, keep="matched")


@query("C4_keep_left", with_sql(WEEKLY_SQL)[:-1] + ", " + HALVES + "SELECT state, yr, wk, revenue, qty, n_items FROM l LEFT JOIN r USING (state, yr, wk)")
def keep_left(spark, sf):
    return joins.merge(*even_odd(spark, sf), KEYS, keep="left")


@query(
    "C5_lookup_many_to_one",
    with_sql(WEEKLY_SQL)[:-1]
    + ", pop AS (SELECT n_name AS state, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 "
    "UNION ALL SELECT 'NOWHERE', 0), p AS (SELECT state, yr, wk, revenue FROM weekly WHERE state <> 'NATION_4') "
    "SELECT state, yr, wk, revenue, population FROM p FULL JOIN pop USING (state)",
)
def lookup(spark, sf):
    pop = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("state"))
        .agg(F.count(F.lit(1)).alias("population"))
    )
    pop = pop.unionByName(spark.createDataFrame([("NOWHERE", 0)], "state string, population long"))
    panel = weekly_table(spark, sf, *KEYS, "revenue").filter(F.col("state") != "NATION_4")
    return joins.merge(panel, pop, ["state"], card="m:1", keep="all")


@query(
    "C6_match_indicator",
    with_sql(WEEKLY_SQL)[:-1] + ", " + HALVES
    + "SELECT state, yr, wk, CAST(CASE WHEN revenue IS NULL THEN 2 WHEN n_items IS NULL THEN 1 ELSE 3 END AS INTEGER) AS merge "
    "FROM l FULL JOIN r USING (state, yr, wk)",
)
def indicator(spark, sf):
    return joins.merge(*even_odd(spark, sf), KEYS, keep="all", indicator="merge").select(*KEYS, "merge")


@query(
    "C7_natural_inner",
    "SELECT o_custkey, o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'",
)
def natural_inner(spark, sf):
    orders = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.natural_join(orders, customers)


@query(
    "C8_join_chain",
    "SELECT a.c_nationkey AS nation, a.n_customers, b.n_suppliers, c.n_orders, n_name FROM "
    "(SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY 1) a JOIN "
    "(SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) b ON a.c_nationkey = b.s_nationkey JOIN "
    "(SELECT c_nationkey, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) c ON a.c_nationkey = c.c_nationkey "
    "JOIN nation ON a.c_nationkey = n_nationkey",
)
def chain(spark, sf):
    customer = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "nation")
    a = customer.groupBy("nation").agg(F.count(F.lit(1)).alias("n_customers"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    per_customer = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("k"))
    c = per_customer.join(customer, ["c_custkey"]).groupBy("nation").agg(F.sum("k").alias("n_orders"))
    d = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return joins.join_all([a, b, c, d])


@query(
    "C9_natural_full",
    "WITH a AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, count(*) AS rich FROM customer WHERE c_acctbal > 9000 GROUP BY 1, 2), "
    "b AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, count(*) AS poor FROM customer WHERE c_acctbal < 0 GROUP BY 1, 2) "
    "SELECT nation, seg, rich, poor FROM a FULL JOIN b USING (nation, seg)",
)
def natural_full(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    a = c.filter(F.col("c_acctbal") > 9000).groupBy("nation", "seg").agg(F.count(F.lit(1)).alias("rich"))
    b = c.filter(F.col("c_acctbal") < 0).groupBy("nation", "seg").agg(F.count(F.lit(1)).alias("poor"))
    return joins.natural_join(a, b, "full_outer")


@query(
    "C10_residuals_on_the_row",
    with_sql(WEEKLY_SQL)[:-1]
    + ", b AS (SELECT regr_slope(price, qty) AS b1, regr_intercept(price, qty) AS a1, regr_slope(revenue, qty) AS b2, regr_intercept(revenue, qty) AS a2 FROM weekly) "
    + f"SELECT state, t, {sig_sql('price - a1 - b1 * qty', 7, '1e-4')} AS price_resid, {sig_sql('revenue - a2 - b2 * qty', 7, '1e-4')} AS revenue_resid FROM weekly, b",
)
def residuals(spark, sf):
    p = weekly_table(spark, sf, "state", "t", "revenue", "price", "qty")
    p = residualize(p, ModelSpec("p", "price", ["qty"]), "price_resid")
    p = residualize(p, ModelSpec("r", "revenue", ["qty"]), "revenue_resid")
    return p.select("state", "t", sig("price_resid", 7, 1e-4).alias("price_resid"), sig("revenue_resid", 7, 1e-4).alias("revenue_resid"))


@query(
    "C11_policy_entity_calendar",
    "WITH f AS (SELECT user_id, event_type, min(CAST(ts AS DATE)) AS d FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2), "
    "u AS (SELECT DISTINCT user_id FROM events), p AS (SELECT unnest(['purchase', 'signup']) AS event_type), "
    "c AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS DATE) AS date) "
    "SELECT date, user_id, event_type, CAST(coalesce(date >= d, false) AS INTEGER) AS implemented FROM u CROSS JOIN p CROSS JOIN c LEFT JOIN f USING (user_id, event_type)",
)
def spine(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", clock_to_date("ts").alias("day"))
    return step_panel_long(ev, "user_id", "event_type", "day", ["purchase", "signup"], *event_days(spark, sf))


@query(
    "C12_reference_row",
    with_sql(DAILY_SQL)[:-1]
    + ", a AS (SELECT * FROM daily UNION ALL SELECT 'ALL', date, sum(n)::BIGINT, round(sum(v), 2) FROM daily GROUP BY date) "
    "SELECT a.state, a.date, a.n, u.n AS us_n, u.v AS us_v FROM a LEFT JOIN (SELECT * FROM a WHERE state = 'ALL') u USING (date)",
)
def reference_row(spark, sf):
    d = daily_types(spark, sf)
    total = d.groupBy("date").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("v")).withColumn("state", F.lit("ALL"))
    return joins.copy_reference_row(d.unionByName(total), "state", "ALL", "date", ["n", "v"], "us_").select("state", "date", "n", "us_n", "us_v")


@query(
    "C13_first_event_dates",
    "SELECT user_id, min(CASE WHEN event_type = 'error' THEN CAST(ts AS DATE) END) AS first_error, "
    "min(CASE WHEN event_type = 'purchase' AND value > 100 THEN CAST(ts AS DATE) END) AS first_big FROM events GROUP BY 1",
)
def first_dates(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", clock_to_date("ts"))
    a = joins.first_date_when(ev, "user_id", "day", F.col("event_type") == "error", "first_error")
    b = joins.first_date_when(ev, "user_id", "day", (F.col("event_type") == "purchase") & (F.col("value") > 100), "first_big")
    return a.join(b, ["user_id"])


BIG = "big AS (SELECT user_id, date, CASE WHEN v > 150 THEN v ELSE 0.0 END AS v FROM users), f AS (SELECT user_id, min(CASE WHEN v > 0 THEN date END) AS d FROM big GROUP BY 1)"


@query(
    "C14_interval_max_own",
    with_sql(USERS_SQL, BIG)
    + "SELECT user_id, coalesce(max(CASE WHEN date BETWEEN d AND d + 5 THEN v END), 0.0) AS early FROM big JOIN f USING (user_id) GROUP BY 1",
)
def interval_own(spark, sf):
    u = daily_users(spark, sf).withColumn("v", F.when(F.col("v") > 150, F.col("v")).otherwise(0.0))
    return joins.max_after_first(u, "user_id", "date", "v", 5, "early")


@query(
    "C14_interval_max_national",
    with_sql(USERS_SQL, BIG, "m AS (SELECT date, max(v) AS mv FROM big GROUP BY 1)")
    + "SELECT user_id, coalesce(max(mv), 0.0) AS early FROM f LEFT JOIN m ON m.date BETWEEN d AND d + 5 GROUP BY 1",
)
def interval_national(spark, sf):
    u = daily_users(spark, sf).withColumn("v", F.when(F.col("v") > 150, F.col("v")).otherwise(0.0))
    return joins.max_after_first(u, "user_id", "date", "v", 5, "early", national=True)


@query(
    "C15_up_to_event",
    with_sql(USERS_SQL, "f AS (SELECT user_id, min(CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'purchase' GROUP BY 1)")
    + "SELECT user_id, round(sum(v), 2) AS v, count(*) AS n_days FROM users JOIN f USING (user_id) WHERE date <= d + 14 GROUP BY 1",
)
def up_to_event(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", clock_to_date("ts"))
    first = joins.first_date_when(ev, "user_id", "day", F.col("event_type") == "purchase", "d")
    rows = joins.up_to_event(daily_users(spark, sf), first, "user_id", "date", "d", 14)
    return rows.groupBy("user_id").agg(F.round(F.sum("v"), 2).alias("v"), F.count(F.lit(1)).alias("n_days"))
