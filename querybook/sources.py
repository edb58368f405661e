"""A: scans, writes, stores. Files are written from the given tables, then read back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from panelspark.functions.scalars import clock_to_date, parse_mdy2
from panelspark.models.grid import run_grid
from panelspark.models.spec import ModelSpec
from panelspark.models.tables import coef_table
from panelspark.operators.joins import Side, merge_many
from panelspark.operators.reshape import literal_table
from panelspark.session import scratch_path
from panelspark.sources.readers import (
    read_csv,
    read_positional_tsv,
    read_report_matrix,
    read_table,
    read_tsv,
    read_wide_csv,
    read_years,
)
from panelspark.sources.writers import ModelStore, export_table, write_table

from .common import DAILY_SQL, WEEKLY_SQL, daily_types, query, sig, sig_sql, table, weekly_panel, weekly_table, with_sql


@query(
    "A1_csv_scan",
    "SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, min(CAST(o_orderdate AS DATE)) AS first_day "
    "FROM orders GROUP BY 1",
)
def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", clock_to_date("o_orderdate").alias("o_orderdate")
    ).write.option("header", True).csv(path)
    df = read_csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date")
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("first_day")
    )


@query("A2_positional_tsv", "SELECT s_name AS country, s_acctbal AS score FROM supplier")
def positional_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("sep", "\t").csv(path)
    return read_positional_tsv(spark, path, "rank long, country string, score double").drop("rank")


@query(
    "A3_headered_tsv",
    "SELECT event_type AS \"State\", CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2",
)
def headered_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    table(spark, sf, "events").select(
        F.col("event_type").alias("State"), F.date_format("ts", "yyyy/MM/dd").alias("Day Code"), "value"
    ).write.option("header", True).option("sep", "\t").csv(path)
    df = read_tsv(spark, path, "State string, `Day Code` string, value double")
    return df.groupBy("State", F.to_date("Day Code", "yyyy/MM/dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("A4_column_pruned_scan", "SELECT l_returnflag, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty FROM lineitem GROUP BY 1")
def pruned(spark, sf):
    df = read_table(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_quantity"])
    return df.groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))


@query(
    "A5_dates_at_scan",
    "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def dates_at_scan(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "events").select(F.date_format("ts", "M/d/yy").alias("date"), "user_id").write.option("header", True).csv(path)
    df = read_csv(spark, path, "date string, user_id long").select(parse_mdy2("date").alias("day"), "user_id")
    return df.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "A6_yearly_files",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1",
)
def yearly_files(spark, sf):
    path = scratch_path(spark, "years")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("yr"))
    orders.write.option("header", True).partitionBy("yr").csv(path)
    years = [r[0] for r in orders.select("yr").distinct().collect()]  # one row per calendar year
    df = read_years(spark, [f"{path}/yr={y}" for y in years], "o_orderkey long, o_custkey long")
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers"))


PRIORITY_CODE = "CASE o_orderpriority WHEN '1-URGENT' THEN 20 WHEN '2-HIGH' THEN 380 WHEN '3-MEDIUM' THEN 400 ELSE NULL END"


@query(
    "A7_report_matrix",
    "SELECT n_name AS entity, sum(CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED','5-LOW') THEN 1 ELSE 0 END)::DOUBLE AS population, "
    "sum(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END)::DOUBLE AS deaths "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def report_matrix(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = orders.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    matrix = (
        named.select(F.expr(PRIORITY_CODE).cast("int").alias("code"), "n_name")
        .groupBy("code")
        .pivot("n_name")
        .agg(F.count(F.lit(1)))
        .withColumn("row_id", F.coalesce(F.col("code"), F.lit(1)))
    )
    names = [c for c in matrix.columns if c not in ("code", "row_id")]
    path = scratch_path(spark, "report")
    matrix.write.option("header", True).csv(path)
    wide = read_wide_csv(spark, path, {"code": "int", "row_id": "int"}, "double")
    return read_report_matrix(wide, "row_id", 1, 399, "code", {"population": [None], "deaths": [20, 380]}, names)


@query("A8_clean_table_read", "SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1")
def clean_read(spark, sf):
    df = read_table(spark, f"{sf}/customer.parquet", ["c_mktsegment", "c_acctbal"])
    return df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("top"))


@query("A9_clean_table_write", with_sql(WEEKLY_SQL) + "SELECT yr, state, wk, revenue, n_items FROM weekly")
def clean_write(spark, sf):
    path = scratch_path(spark, "panel")
    write_table(weekly_panel(spark, sf), path, partition_by=["yr"])
    return read_table(spark, path).select("yr", "state", "wk", "revenue", "n_items")


@query(
    "A10_model_store",
    with_sql(WEEKLY_SQL)
    + f"SELECT 'second' AS model_id, 'qty' AS term, {sig_sql('regr_slope(revenue, qty)')} AS estimate, count(*) AS n FROM weekly",
)
def model_store(spark, sf):
    store = ModelStore(spark, scratch_path(spark, "models"))
    grid = run_grid(weekly_panel(spark, sf), [ModelSpec("first", "revenue", ["price"]), ModelSpec("second", "revenue", ["qty"])])
    store.save("weekly", grid.fits)
    coefs = store.coefficients("weekly", 2).filter(F.col("term") == "qty").select("model_id", "term", sig("estimate").alias("estimate"))
    return coefs.join(store.models("weekly", 2).select("model_id", "n"), ["model_id"])


@query(
    "A11_scoped_side_tables",
    with_sql(
        WEEKLY_SQL,
        "inf AS (SELECT state, yr, wk, sum(n_items)::BIGINT AS infections FROM weekly WHERE wk % 2 = 0 GROUP BY 1, 2, 3)",
        "pop AS (SELECT n_name AS state, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)",
    )
    + "SELECT state, yr, wk, revenue, infections, population FROM weekly LEFT JOIN inf USING (state, yr, wk) LEFT JOIN pop USING (state)",
)
def side_tables(spark, sf):
    panel = weekly_table(spark, sf)
    side = panel.filter(F.col("wk") % 2 == 0).groupBy("state", "yr", "wk").agg(F.sum("n_items").alias("infections"))
    nations = table(spark, sf, "nation")
    pop = (
        table(spark, sf, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("state"))
        .agg(F.count(F.lit(1)).alias("population"))
    )
    out = merge_many(
        panel.select("state", "yr", "wk", "revenue"), [Side(side, known_unique=True)], ["state", "yr", "wk"], left_unique=True, null_keys=False
    )
    return merge_many(out, [Side(pop, card="m:1", known_unique=True)], ["state"])


@query("A12_table_export")
def table_export(spark, sf):
    grid = run_grid(
        weekly_panel(spark, sf),
        [ModelSpec("a", "revenue", ["qty"]), ModelSpec("b", "revenue", ["qty", "n_items"], vce="cluster", cluster="state")],
    )
    path = scratch_path(spark, "tables")
    export_table(coef_table(grid.coefficients, grid.models, ["qty", "n_items", "_cons"], ["a", "b"]), path, order=["row"])
    return spark.read.text(path)


@query(
    "A13_literal_event_dates",
    with_sql(DAILY_SQL, "marks AS (SELECT * FROM (VALUES (DATE '2024-01-10', 'restriction'), (DATE '2024-01-20', 'stay_home')) m(date, policy))")
    + "SELECT policy, date, state, n FROM daily JOIN marks USING (date)",
)
def literal_dates(spark, sf):
    marks = literal_table(
        spark, [(date(2024, 1, 10), "restriction"), (date(2024, 1, 20), "stay_home")], "date date, policy string"
    )
    return daily_types(spark, sf).join(F.broadcast(marks), ["date"]).select("policy", "date", "state", "n")
