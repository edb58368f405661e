"""Wide/long reshapes, set operations, row replication, calendars."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None, names_to: str, value_name: str) -> DataFrame:
    """Wide to long; missing cells stay as rows. One narrow pass, no shuffle."""
    cols = [c for c in df.columns if c not in ids] if values is None else list(values)
    quoted = [F.col(f"`{c}`") for c in cols]
    return df.unpivot([F.col(f"`{i}`") for i in ids], quoted, names_to, value_name)


def to_wide(df: DataFrame, ids: Sequence[str], names_from: str, values: Sequence, agg: Column) -> DataFrame:
    """Long to wide with the output columns given, so no job is needed to find them."""
    return df.groupBy(*ids).pivot(names_from, list(values)).agg(agg)


def transpose(df: DataFrame, label: str, labels: Sequence[str], names_to: str) -> DataFrame:
    """Turn a matrix with a row label column into one row per former column."""
    long = to_long(df, [label], None, names_to, "__v")
    return to_wide(long, [names_to], label, labels, F.first("__v"))


def union_all(tables: Sequence[DataFrame], fill: bool = False) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), tables)


def append_total(df: DataFrame, label: str, name: str, cols: Sequence[str], rows: Column | None = None) -> DataFrame:
    """Append one row holding the column sums of (some of) the rows."""
    picked = df if rows is None else df.filter(rows)
    total = picked.agg(*[F.sum(c).alias(c) for c in cols]).withColumn(label, F.lit(name))
    return df.unionByName(total, allowMissingColumns=True)


def expand(df: DataFrame, n: int, number: str = "number") -> DataFrame:
    """Replicate each row ``n`` times, numbered 1..n. Narrow: no shuffle, no sort."""
    return df.withColumn(number, F.explode(F.sequence(F.lit(1), F.lit(n))))


def calendar(df: DataFrame, start: date | Column, end: date | Column, name: str) -> DataFrame:
    """Repeat each row for every day from start to end."""
    first = start if isinstance(start, Column) else F.lit(start)
    last = end if isinstance(end, Column) else F.lit(end)
    return df.withColumn(name, F.explode(F.sequence(first, last)))


def ordered_head(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First n rows in a total order (Spark keeps n rows per task, then merges)."""
    return df.orderBy(*order).limit(n)


def sort_for_output(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ascending with missing values last."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def literal_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small literal table with an explicit schema."""
    return spark.createDataFrame(list(rows), schema)


def mapping_table(spark, mapping: Mapping[str, str], key: str, label: str) -> DataFrame:
    return spark.createDataFrame(sorted(mapping.items()), f"{key} string, {label} string")
