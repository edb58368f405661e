"""Projections, filters and recodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_col, blank_to_null
from .joins import assert_unique


def columns_from(df: DataFrame, start: int, stop: int | None = None, also: Sequence[int] = ()) -> list[str]:
    """Names of a column range by position, preceded by single positions."""
    names = df.columns
    return [names[i] for i in also] + names[start:stop]


def select_range(df: DataFrame, start: int, stop: int | None = None, also: Sequence[int] = ()) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns_from(df, start, stop, also)])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def derive(df: DataFrame, **exprs: Column) -> DataFrame:
    """Computed columns that all see the same input row."""
    return df.withColumns(exprs)


def keep_in(df: DataFrame, col: str, values: Sequence, or_null: bool = False) -> DataFrame:
    cond = F.col(col).isin(*values)
    return df.filter(cond | F.col(col).isNull() if or_null else cond)


def keep_not_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Rows whose value is missing are kept: a missing value is in no list."""
    return df.filter(~F.coalesce(F.col(col).isin(*values), F.lit(False)))


def drop_blank(df: DataFrame, *cols: str) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & blank_to_null(c).isNotNull()
    return df.filter(cond)


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows on which every listed column is present and not NaN."""
    return df.na.drop(subset=list(cols))


def rows_between(df: DataFrame, row_col: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Row-position filter on an explicit row number column."""
    cond = F.lit(True)
    if first is not None:
        cond = cond & (F.col(row_col) >= first)
    if last is not None:
        cond = cond & (F.col(row_col) <= last)
    return df.filter(cond)


def in_period(df: DataFrame, col: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Inclusive date range; an open side is unbounded."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(col) >= F.lit(start))
    if end is not None:
        cond = cond & (F.col(col) <= F.lit(end))
    return df.filter(cond)


def in_year(df: DataFrame, col: str, year: int) -> DataFrame:
    """Calendar-year filter as a range, so that it reaches the scan."""
    c = F.col(col)
    return df.filter((c >= F.lit(date(year, 1, 1))) & (c < F.lit(date(year + 1, 1, 1))))


def replace_if(df: DataFrame, col: str, cond: Column, value) -> DataFrame:
    """Conditional update; a missing condition leaves the value as it is."""
    new = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(col, F.when(cond, new).otherwise(F.col(col)))


def recode(df: DataFrame, col: str, mapping: Mapping[str, str] | DataFrame, trim: bool = False) -> DataFrame:
    """Replace listed values of a key, leave all others.

    A mapping becomes one lookup in a constant map. A mapping table has columns ``old`` and ``new``; it is joined,
    and the job fails if an ``old`` value repeats in it.
    """
    source = F.trim(F.col(col)) if trim else F.col(col)
    if isinstance(mapping, Mapping):
        if not mapping:
            return df.withColumn(col, source)
        pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        return df.withColumn(col, F.coalesce(F.try_element_at(pairs, source), source))
    names = df.columns
    table = assert_unique(mapping.where("old IS NOT NULL").select(F.col("old").alias("__old"), F.col("new").alias("__new")), ["__old"], "recode")
    joined = df.withColumn(col, source).join(table, F.col(col) == F.col("__old"), "left")
    return joined.withColumn(col, F.coalesce("__new", col)).select(*[F.col(f"`{c}`") for c in names])


def poly(col: str | Column, degree: int, name: str | None = None, only: Sequence[int] | None = None):
    """Power terms ``(name, expression)`` of degree 1..degree, or only the listed degrees. For a column's name the expressions are SQL text, so
    that a list of models can be made before there is a session."""
    label = name or (col if isinstance(col, str) else "x")
    out = []
    for d in range(1, degree + 1):
        if only is None or d in only:
            if isinstance(col, str):
                term = " * ".join([f"double(`{col}`)"] * d)
            else:
                term = as_col(col).cast("double")
                for _ in range(d - 1):
                    term = term * col.cast("double")
            out.append((label if d == 1 else f"{label}^{d}", term))
    return out


def interact(factor: str, levels: Sequence, col: str | Column, name: str | None = None):
    """Factor × continuous terms: the value on rows of the level, else 0."""
    value = as_col(col).cast("double")
    label = name or (col if isinstance(col, str) else "x")
    return [
        (f"{factor}={lv}:{label}", F.when(F.col(factor) == F.lit(lv), value).otherwise(F.lit(0.0) * value))
        for lv in levels
    ]


def cross_factors(a: str, levels_a: Sequence, b: str, levels_b: Sequence):
    """Factor × factor indicator terms."""
    return [
        (f"{a}={i}:{b}={j}", ((F.col(a) == F.lit(i)) & (F.col(b) == F.lit(j))).cast("double"))
        for i in levels_a
        for j in levels_b
    ]
