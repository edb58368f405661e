"""E: sorts, set operations, reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import reshape

from .common import DAILY_SQL, daily_types, query, table, values_of, with_sql


@query("E1_sort", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey")
def e1(spark, sf):
    return reshape.sort_for_output(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderkey"])


@query("E2_head", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 3")
def e2(spark, sf):
    return reshape.ordered_head(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], 3)


@query(
    "E3_union_all",
    "SELECT c_name AS name, c_nationkey AS nation, 'c' AS kind FROM customer UNION ALL SELECT s_name, s_nationkey, 's' FROM supplier",
)
def e3(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("s").alias("kind"))
    return reshape.union_all([c, s])


@query(
    "E4_append_computed_row",
    with_sql("m AS (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1)")
    + "SELECT seg, n FROM m UNION ALL SELECT 'BUILDING+MACHINERY', sum(n)::BIGINT FROM m WHERE seg IN ('BUILDING', 'MACHINERY')",
)
def e4(spark, sf):
    m = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n"))
    return reshape.append_total(m, "seg", "BUILDING+MACHINERY", ["n"], F.col("seg").isin("BUILDING", "MACHINERY"))


@query(
    "E5_row_replication",
    "SELECT o_orderkey, CAST(number AS INTEGER) AS number, CASE WHEN number = 2 THEN -o_totalprice ELSE o_totalprice END AS both "
    "FROM orders CROSS JOIN (SELECT unnest([1, 2]) AS number)",
)
def e5(spark, sf):
    o = reshape.expand(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 2)
    both = F.when(F.col("number") == 2, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", "number", both.alias("both"))


@query(
    "E6_wide_to_long",
    "SELECT p_partkey, measure, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) "
    "UNPIVOT INCLUDE NULLS (value FOR measure IN (p_size, p_retailprice))",
)
def e6(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return reshape.to_long(p, ["p_partkey"], None, "measure", "value")


@query(
    "E7_long_to_wide",
    with_sql(DAILY_SQL) + "SELECT * FROM (PIVOT (SELECT date, state, n FROM daily) ON state USING max(n) GROUP BY date)",
)
def e7(spark, sf):
    types = values_of(table(spark, sf, "events"), "event_type")
    return reshape.to_wide(daily_types(spark, sf), ["date"], "state", types, F.first("n"))


@query(
    "E8_transpose",
    "WITH m AS (SELECT c_mktsegment AS seg, CAST(count(*) AS DOUBLE) AS n, CAST(max(c_acctbal) AS DOUBLE) AS top FROM customer GROUP BY 1) "
    "SELECT * FROM (PIVOT (SELECT 'n' AS stat, seg, n AS v FROM m UNION ALL SELECT 'top', seg, top FROM m) ON seg USING max(v) GROUP BY stat)",
)
def e8(spark, sf):
    m = (
        table(spark, sf, "customer")
        .groupBy(F.col("c_mktsegment").alias("seg"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("c_acctbal").alias("top"))
    )
    return reshape.transpose(m, "seg", values_of(table(spark, sf, "customer"), "c_mktsegment"), "stat")
