"""Registry, table access and the stand-in panels the queries share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.scalars import clock_to_date, signif, week52
from panelspark.session import materialize

@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def values_of(df: DataFrame, column: str, most: int = 1000) -> list:
    """The sorted values of a column that become columns of a result; more than ``most`` are an error."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)


def event_days(spark: SparkSession, sf: str) -> tuple:
    """First and last day of the events."""
    day = clock_to_date("ts")
    return tuple(table(spark, sf, "events").agg(F.min(day), F.max(day)).first())


def sig(col, digits: int = 9, zero: float = 1e-9):
    return signif(col, digits, zero)


def sig_sql(x: str, digits: int = 9, zero: str = "1e-9") -> str:
    """SQL form of ``signif``."""
    v = f"CAST(({x}) AS DOUBLE)"
    s = f"({digits - 1} - CAST(floor(log10(abs({v}))) AS INTEGER))"
    return (
        f"CASE WHEN {v} IS NULL THEN NULL WHEN abs({v}) < {zero} THEN 0.0 "
        f"WHEN {s} >= 0 THEN round({v} * pow(10.0, {s})) / pow(10.0, {s}) "
        f"ELSE round({v} / pow(10.0, -{s})) * pow(10.0, -{s}) END"
    )


WEEK_SQL = "CAST(least(52, (dayofyear({0}) - 1) // 7 + 1) AS INTEGER)"


def week_sql(col: str) -> str:
    return WEEK_SQL.format(col)


# -- weekly panel: nation × year × week of the order date ----------------------


def weekly_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(state, yr, wk, t, revenue, price, qty, n_items, disc).

    Line items are summed per order first: that aggregate and the join with orders share one
    shuffle on the order key. Sums of cents are rounded to what the input can express.
    """
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
            F.sum("l_extendedprice").alias("price"),
            F.sum("l_quantity").alias("qty"),
            F.count(F.lit(1)).alias("n_items"),
            F.sum("l_discount").alias("disc"),
        )
    )
    day = clock_to_date("o_orderdate")
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.year(day).alias("yr"), week52(day).alias("wk")
    )
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("state", "yr", "wk")
        .agg(
            F.round(F.sum("revenue"), 4).alias("revenue"),
            F.round(F.sum("price"), 2).alias("price"),
            F.round(F.sum("qty"), 0).alias("qty"),
            F.sum("n_items").alias("n_items"),
            F.round(F.sum("disc"), 2).alias("disc"),
        )
        .withColumn("t", ((F.col("yr") - 1995) * 52 + F.col("wk")).cast("int"))
    )


def weekly_table(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """The panel as a written table, for queries that read it more than once: the raw tables
    are then scanned once."""
    panel = weekly_panel(spark, sf)
    return materialize(panel.select(*cols) if cols else panel, "weekly")


WEEKLY_SQL = f"""weekly AS (
  SELECT *, CAST((yr - 1995) * 52 + wk AS INTEGER) AS t FROM (
    SELECT n_name AS state, CAST(year(o_orderdate) AS INTEGER) AS yr, {week_sql('o_orderdate')} AS wk,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(sum(l_extendedprice), 2) AS price,
           round(sum(l_quantity), 0) AS qty, count(*) AS n_items, round(sum(l_discount), 2) AS disc
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3) w0)"""


# -- daily panels from events ---------------------------------------------------


def daily_types(spark: SparkSession, sf: str) -> DataFrame:
    """(state, date, n, v): event type × day."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("state"), clock_to_date("ts").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v"))
    )


DAILY_SQL = """daily AS (
  SELECT event_type AS state, CAST(ts AS DATE) AS date, count(*) AS n, round(sum(value), 2) AS v
  FROM events GROUP BY 1, 2)"""


def daily_users(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, date, n, v): user × day, sparse."""
    return (
        table(spark, sf, "events")
        .groupBy("user_id", clock_to_date("ts").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v"))
    )


USERS_SQL = """users AS (
  SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n, round(sum(value), 2) AS v
  FROM events GROUP BY 1, 2)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def rounded(df: DataFrame, cols: Sequence[str], digits: int = 9, zero: float = 1e-9) -> DataFrame:
    return df.withColumns({c: sig(c, digits, zero) for c in cols})
