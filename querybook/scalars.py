"""F: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import scalars as S
from panelspark.operators.reshape import calendar

from .common import WEEKLY_SQL, query, sig, sig_sql, table, week_sql, weekly_panel, with_sql


@query(
    "F1_substring_date",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_a, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_b FROM orders",
)
def f1(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        S.month_start(F.date_format("o_orderdate", "yyyyMM"), "yyyyMM").alias("month_a"),
        S.month_start(F.date_format("o_orderdate", "yyyy/MM"), "yyyy/MM").alias("month_b"),
    )


@query(
    "F2_strip_citations",
    "SELECT c_custkey, CASE WHEN c_custkey % 140 BETWEEN 1 AND 130 THEN c_name ELSE c_name || '[' || (c_custkey % 140) || ']' END AS name FROM customer",
)
def f2(spark, sf):
    marked = F.concat(F.col("c_name"), F.lit("["), (F.col("c_custkey") % 140).cast("string"), F.lit("]"))
    return table(spark, sf, "customer").select("c_custkey", S.strip_citations(marked).alias("name"))


@query("F3_digits_only", "SELECT event_id, TRY_CAST(nullif(regexp_replace(props, '[^0-9]', '', 'g'), '') AS BIGINT) AS k FROM events")
def f3(spark, sf):
    return table(spark, sf, "events").select("event_id", S.digits_only("props").alias("k"))


@query("F4_ascii_only", "SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS h FROM documents")
def f4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.ascii_only("text")).alias("h"))


@query(
    "F5_parse_dates",
    "SELECT event_id, CAST(ts AS DATE) AS mdy, CAST(ts AS DATE) AS ymd, CAST(NULL AS DATE) AS bad FROM events",
)
def f5(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        S.parse_mdy2(F.date_format("ts", "M/d/yy")).alias("mdy"),
        S.parse_ymd(F.date_format("ts", "yyyy-MM-dd")).alias("ymd"),
        S.parse_date(F.col("event_type"), "yyyy-MM-dd").alias("bad"),
    )


@query(
    "F6_F7_F8_calendar_parts",
    f"SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS yr, {week_sql('o_orderdate')} AS wk FROM orders",
)
def f678(spark, sf):
    day = S.clock_to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", day.alias("day"), F.year(day).alias("yr"), S.week52(day).alias("wk"))


@query(
    "F9_F10_day_distance",
    "SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS days, "
    "CAST(l_shipdate AS DATE) BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + 30 AS soon FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def f910(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ship, order = S.clock_to_date("l_shipdate"), S.clock_to_date("o_orderdate")
    return j.select("l_orderkey", "l_linenumber", S.days_between(ship, order).alias("days"), S.within_days(ship, order, 30).alias("soon"))


@query(
    "F11_daily_calendar",
    "SELECT o_orderstatus, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM "
    "(SELECT o_orderstatus, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1)",
)
def f11(spark, sf):
    day = S.clock_to_date("o_orderdate")
    spans = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return calendar(spans, F.col("a"), F.col("b"), "day").select("o_orderstatus", "day")


@query(
    "F12_logs",
    with_sql(WEEKLY_SQL)
    + f"SELECT state, t, {sig_sql('CASE WHEN disc > 0 THEN ln(disc) END')} AS log_disc, {sig_sql('CASE WHEN disc > 0 THEN ln(10000.0 * disc / qty) END')} AS log_rate FROM weekly",
)
def f12(spark, sf):
    return weekly_panel(spark, sf).select(
        "state", "t", sig(S.safe_ln("disc")).alias("log_disc"), sig(S.scaled_log_rate("disc", "qty", 10000)).alias("log_rate")
    )


@query("F13_powers", f"SELECT l_orderkey, l_linenumber, l_quantity * l_quantity * l_quantity AS cube, {sig_sql('l_quantity * l_tax')} AS prod FROM lineitem")
def f13(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", S.power("l_quantity", 3).alias("cube"), sig(F.col("l_quantity") * F.col("l_tax")).alias("prod")
    )


@query(
    "F14_if_else_missing",
    "SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS grade FROM documents LEFT JOIN labels USING (doc_id)",
)
def f14(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), ["doc_id"], "left")
    grade = F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "good").otherwise("bad")
    return d.select("doc_id", grade.alias("grade"))


@query(
    "F15_rounding_and_display",
    "SELECT o_orderkey, format('{:,}', CAST(o_orderkey * 1234 AS BIGINT)) AS grouped, "
    "lower(strftime(o_orderdate, '%d%b%Y')) AS day, round(o_totalprice / 8) AS eighth FROM orders",
)
def f15(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        S.fixed_text(F.col("o_orderkey") * 1234, 0).alias("grouped"),
        S.day_text("o_orderdate").alias("day"),
        F.round(F.col("o_totalprice") / 8).alias("eighth"),
    )
