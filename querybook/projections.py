"""B: projections, filters, recodes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from panelspark.functions.scalars import clock_to_date, null_to_sentinel, safe_div, sentinel_to_null, tolerant_cast
from panelspark.models.spec import ModelSpec, coefficients
from panelspark.models.engine import fit_all
from panelspark.operators import clean
from panelspark.operators.panel import Panel, lag_by
from panelspark.operators.reshape import mapping_table, to_long

from .common import WEEKLY_SQL, daily_types, query, sig, sig_sql, table, weekly_panel, with_sql


@query(
    "B1_B3_B4_select_drop_rename",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer",
)
def select_rename(spark, sf):
    df = table(spark, sf, "customer").drop("c_nationkey")
    return clean.rename(df, {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance", "c_mktsegment": "segment"})


@query("B2_select_by_position", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem")
def by_position(spark, sf):
    return clean.select_range(table(spark, sf, "lineitem"), 3, 7, also=[0])


@query(
    "B5_role_swap",
    with_sql(WEEKLY_SQL)
    + f"SELECT 'm_price' AS model_id, 'mobility' AS role, {sig_sql('regr_slope(revenue, price)')} AS estimate FROM weekly "
    f"UNION ALL SELECT 'm_qty', 'mobility', {sig_sql('regr_slope(revenue, qty)')} FROM weekly",
)
def role_swap(spark, sf):
    specs = [
        ModelSpec(f"m_{c}", "revenue", [c], vce="classical", roles={c: "mobility"}) for c in ("price", "qty")
    ]
    out = coefficients(spark, fit_all(weekly_panel(spark, sf), specs))
    return out.filter(F.col("role") == "mobility").select("model_id", "role", sig("estimate").alias("estimate"))


@query(
    "B6_computed_columns",
    with_sql(WEEKLY_SQL)
    + f"SELECT state, yr, wk, {sig_sql('revenue / n_items')} AS per_item, {sig_sql('disc / nullif(n_items - 1, 0)')} AS disc_rate, "
    "qty + 1 AS qty_shift, price / 100 AS price_scaled FROM weekly",
)
def computed(spark, sf):
    df = clean.derive(
        weekly_panel(spark, sf),
        per_item=sig(safe_div("revenue", "n_items")),
        disc_rate=sig(safe_div("disc", F.col("n_items") - 1)),
        qty_shift=F.col("qty") + 1,
        price_scaled=F.col("price") / 100,
    )
    return df.select("state", "yr", "wk", "per_item", "disc_rate", "qty_shift", "price_scaled")


@query(
    "B7_conjunctive_filter",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_discount <> 0.05",
)
def conjunctive(spark, sf):
    df = table(spark, sf, "lineitem")
    cond = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O") & (F.col("l_discount") != 0.05)
    return df.filter(cond).select("l_orderkey", "l_linenumber")


@query(
    "B8_in_list",
    "WITH d AS (SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)) "
    "SELECT doc_id, lang, quality FROM d WHERE lang NOT IN ('de', 'fr') AND (quality IN (1) OR quality IS NULL)",
)
def in_list(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], "left")
    return clean.keep_in(clean.keep_not_in(df, "lang", ["de", "fr"]), "quality", [1], or_null=True)


@query(
    "B9_null_and_blank",
    "SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE lang END AS lang, quality FROM documents JOIN labels USING (doc_id) "
    "WHERE lang <> 'fr' AND quality IS NOT NULL",
)
def null_and_blank(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), ["doc_id"], "left").select("doc_id", "lang", "quality")
    blanked = df.withColumn("lang", F.when(F.col("lang") == "fr", "").otherwise(F.col("lang")))
    kept = clean.drop_blank(blanked, "lang").filter(F.col("quality").isNotNull())
    return kept.withColumn("lang", sentinel_to_null("lang", "de"))


@query(
    "B10_row_position_and_head",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 5000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def row_position(spark, sf):
    df = clean.rows_between(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 5000)
    return df.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query(
    "B11_date_filters",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, 'year' AS rule FROM orders WHERE year(o_orderdate) = 1998 "
    "UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE), 'range' FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1999-04-17' AND DATE '1999-08-11' "
    "UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE), 'from' FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2001-02-14'",
)
def date_filters(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", clock_to_date("o_orderdate").alias("day"))
    parts = [
        clean.in_year(df, "day", 1998).withColumn("rule", F.lit("year")),
        clean.in_period(df, "day", date(1999, 4, 17), date(1999, 8, 11)).withColumn("rule", F.lit("range")),
        clean.in_period(df, "day", date(2001, 2, 14)).withColumn("rule", F.lit("from")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "B12_conditional_update",
    with_sql(WEEKLY_SQL) + "SELECT state, yr, wk, CASE WHEN n_items = 1 THEN 0.0 ELSE disc END AS disc FROM weekly",
)
def conditional_update(spark, sf):
    df = clean.replace_if(weekly_panel(spark, sf), "disc", F.col("n_items") == 1, 0.0)
    return df.select("state", "yr", "wk", "disc")


@query(
    "B13_recode_keys",
    "SELECT CASE n_name WHEN 'NATION_3' THEN 'Three' WHEN 'NATION_7' THEN 'Seven' ELSE n_name END AS country, count(*) AS n "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def recode_keys(spark, sf):
    df = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = clean.recode(df.select(F.col("n_name").alias("country")), "country", {"NATION_3": "Three", "NATION_7": "Seven"})
    return named.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query(
    "B14_header_codes",
    "SELECT CAST(ts AS DATE) AS date, upper(event_type[1]) || event_type[2:] AS state, count(*) AS n FROM events GROUP BY 1, 2",
)
def header_codes(spark, sf):
    wide = daily_types(spark, sf).groupBy("date").pivot("state").agg(F.sum("n"))
    types = [c for c in wide.columns if c != "date"]
    wide = wide.withColumnRenamed(types[0], f" {types[0]}")  # a header with a leading blank
    codes = mapping_table(spark, {c: c.capitalize() for c in types}, "old", "new")
    long = to_long(wide, ["date"], None, "state", "n")
    return clean.recode(long, "state", codes, trim=True).filter(F.col("n").isNotNull())


@query(
    "B15_sentinels",
    "SELECT doc_id, nullif(quality, 0) AS quality, coalesce(nullif(quality, 0), -99) AS coded FROM labels",
)
def sentinels(spark, sf):
    df = table(spark, sf, "labels").select("doc_id", sentinel_to_null("quality", 0).alias("quality"))
    return df.withColumn("coded", null_to_sentinel("quality", -99))


@query(
    "B16_tolerant_cast",
    "SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'Suppressed' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value FROM events",
)
def tolerant(spark, sf):
    text = F.when(F.col("event_type") == "error", "Suppressed").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", tolerant_cast(text, "double").alias("value"))


@query(
    "B17_complete_cases",
    with_sql(WEEKLY_SQL)
    + "SELECT state, t, revenue, revenue_m1, revenue_m4 FROM (SELECT state, t, revenue, lag(revenue, 1) OVER w AS revenue_m1, "
    "lag(revenue, 4) OVER w AS revenue_m4 FROM weekly WINDOW w AS (PARTITION BY state ORDER BY t)) WHERE revenue_m1 IS NOT NULL AND revenue_m4 IS NOT NULL",
)
def complete(spark, sf):
    df = lag_by(Panel(weekly_panel(spark, sf), "state", "t"), ["revenue"], [1, 4])
    return clean.complete_cases(df, ["revenue_m1", "revenue_m4"]).select("state", "t", "revenue", "revenue_m1", "revenue_m4")
