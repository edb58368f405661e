"""D: group statistics, roll-ups, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.scalars import clock_to_date, mean_strict, sum_strict, sum_zero, week52
from panelspark.operators import aggregates as agg
from panelspark.operators.joins import duplicate_keys

from .common import DAILY_SQL, USERS_SQL, WEEKLY_SQL, daily_types, daily_users, query, sig, sig_sql, table, values_of, week_sql, weekly_table, with_sql

SPARSE = "docs AS (SELECT lang, source, CASE WHEN toxic = 0 THEN n_chars END AS chars FROM documents LEFT JOIN labels USING (doc_id))"


def sparse_docs(spark, sf):
    """Character counts that are missing where a document has no label or is toxic."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf, "labels"), ["doc_id"], "left").select(
        "lang", "source", F.when(F.col("toxic") == 0, F.col("n_chars")).alias("chars")
    )


@query("D1_sum_zero", with_sql(SPARSE) + "SELECT lang, source, coalesce(sum(chars), 0)::BIGINT AS chars FROM docs GROUP BY 1, 2")
def d1(spark, sf):
    return sparse_docs(spark, sf).groupBy("lang", "source").agg(sum_zero("chars").alias("chars"))


@query(
    "D2_sum_strict",
    with_sql(SPARSE)
    + "SELECT lang, source, (CASE WHEN count(chars) = count(*) THEN sum(chars) END)::BIGINT AS chars FROM docs GROUP BY 1, 2",
)
def d2(spark, sf):
    return sparse_docs(spark, sf).groupBy("lang", "source").agg(sum_strict("chars").alias("chars"))


@query(
    "D3_mean",
    with_sql(SPARSE)
    + f"SELECT lang, {sig_sql('avg(chars)')} AS mean_chars, {sig_sql('CASE WHEN count(chars) = count(*) THEN avg(chars) END')} AS strict FROM docs GROUP BY 1",
)
def d3(spark, sf):
    return sparse_docs(spark, sf).groupBy("lang").agg(sig(F.avg("chars")).alias("mean_chars"), sig(mean_strict("chars")).alias("strict"))


@query(
    "D4_D5_D6_first_last_max",
    with_sql(DAILY_SQL) + f"SELECT state, {week_sql('date')} AS wk, arg_min(n, date) AS first_n, arg_max(n, date) AS last_n, max(v) AS top FROM daily GROUP BY 1, 2",
)
def d456(spark, sf):
    d = daily_types(spark, sf).withColumn("wk", week52("date"))
    return agg.collapse(d, ["state", "wk"], {"first_n": ("first", "n"), "last_n": ("last", "n"), "top": ("max", "v")}, order="date")


@query(
    "D7_mixed_collapse",
    with_sql(DAILY_SQL)
    + f"SELECT state, {week_sql('date')} AS wk, arg_max(v, date) AS v, {sig_sql('avg(n)')} AS n, min(date) AS date, {sig_sql('stddev_samp(v)')} AS v_sd "
    "FROM daily GROUP BY 1, 2",
)
def d7(spark, sf):
    d = daily_types(spark, sf).withColumn("wk", week52("date"))
    out = agg.collapse(
        d, ["state", "wk"], {"v": "last", "n": "mean", "date": ("min", "date"), "v_sd": ("sd", "v")}, order="date"
    )
    return out.withColumns({"n": sig("n"), "v_sd": sig("v_sd")})


@query(
    "D8_two_level_rollup",
    with_sql("d AS (SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY user_id % 10, event_type, 2)",
             f"e AS (SELECT event_type, date, {week_sql('date')} AS wk, sum(n) AS n FROM d GROUP BY 1, 2, 3)")
    + f"SELECT event_type, wk, {sig_sql('avg(n)')} AS n, min(date) AS date FROM e GROUP BY 1, 2",
)
def d8(spark, sf):
    county = (
        table(spark, sf, "events")
        .groupBy((F.col("user_id") % 10).alias("county"), "event_type", clock_to_date("ts").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("wk", week52("date"))
    )
    return agg.two_level(county, ["event_type", "date"], ["event_type", "wk"], "n", "date").withColumn("n", sig("n"))


@query(
    "D9_cause_total",
    "SELECT c_nationkey, sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_custkey END)::BIGINT AS total FROM customer GROUP BY 1",
)
def d9(spark, sf):
    return agg.code_total(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment", ["BUILDING", "MACHINERY"], "c_custkey", "total")


@query(
    "D10_pooled_rate",
    with_sql(WEEKLY_SQL, "y AS (SELECT state, yr, sum(n_items) AS deaths, sum(qty) AS pop FROM weekly GROUP BY 1, 2), k AS (SELECT count(DISTINCT yr) AS k FROM y)")
    + f"SELECT state, sum(pop) / max(k) AS pop, {sig_sql('sum(deaths) / (sum(pop) / max(k))')} AS rate FROM y, k GROUP BY 1",
)
def d10(spark, sf):
    p = weekly_table(spark, sf)
    years = p.select("yr").distinct().count()
    yearly = p.groupBy("state", "yr").agg(F.sum("n_items").alias("deaths"), F.sum("qty").alias("pop"))
    return agg.pooled_rate(yearly, "state", "deaths", "pop", years, "rate").withColumn("rate", sig("rate"))


@query(
    "D11_summarize",
    "SELECT count(l_tax) AS l_tax_n, " + ", ".join(f"{sig_sql(f'{f}(l_tax)')} AS l_tax_{n}" for f, n in (("avg", "mean"), ("stddev_samp", "sd"))) + ", min(l_tax) AS l_tax_min, max(l_tax) AS l_tax_max FROM lineitem",
)
def d11(spark, sf):
    out = agg.summarize(table(spark, sf, "lineitem"), ["l_tax"])
    return out.withColumns({"l_tax_mean": sig("l_tax_mean"), "l_tax_sd": sig("l_tax_sd")})


@query(
    "D12_group_stats_on_rows",
    "SELECT o_orderkey, o_orderpriority, " + sig_sql("avg(o_totalprice) OVER (PARTITION BY o_orderpriority)") + " AS m, "
    + sig_sql("stddev_samp(o_totalprice) OVER (PARTITION BY o_orderpriority)") + " AS s FROM orders",
)
def d12(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = agg.attach_group_stats(o, ["o_orderpriority"], {"m": ("mean", "o_totalprice"), "s": ("sd", "o_totalprice")})
    return out.select("o_orderkey", "o_orderpriority", sig("m").alias("m"), sig("s").alias("s"))


@query("D13_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def d13(spark, sf):
    return agg.distinct_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query(
    "D14_one_row_per_key",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def d14(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return agg.one_row_per_key(o, ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("D15_distinct_values", "SELECT DISTINCT source FROM documents")
def d15(spark, sf):
    return agg.distinct_values(table(spark, sf, "documents"), "source")


@query(
    "D16_scalar_min_date",
    "SELECT min(CAST(l_shipdate AS DATE)) AS first_return, max(CAST(l_shipdate AS DATE)) AS last_return FROM lineitem WHERE l_returnflag = 'R'",
)
def d16(spark, sf):
    day = clock_to_date("l_shipdate")
    return table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").agg(F.min(day).alias("first_return"), F.max(day).alias("last_return"))


@query(
    "D17_share_of_total",
    with_sql(USERS_SQL) + f"SELECT user_id, date, sum(n) OVER (PARTITION BY date)::BIGINT AS total, {sig_sql('n / sum(n) OVER (PARTITION BY date)')} AS share FROM users",
)
def d17(spark, sf):
    out = agg.share_of_group(daily_users(spark, sf).select("user_id", "date", "n"), ["date"], "n", "share", total="total")
    return out.select("user_id", "date", "total", sig("share").alias("share"))


@query(
    "D18_band_rollup",
    "SELECT *, \"FURNITURE\" + \"HOUSEHOLD\" AS home FROM (PIVOT (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) ON c_mktsegment USING max(n) GROUP BY c_nationkey)",
)
def d18(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment", F.lit(1).cast("long").alias("one"))
    return agg.band_rollup(c, ["c_nationkey"], "c_mktsegment", "one", values_of(c, "c_mktsegment"), {"home": ["FURNITURE", "HOUSEHOLD"]})


@query(
    "D19_duplicate_keys",
    "SELECT l_partkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def d19(spark, sf):
    return duplicate_keys(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])
