"""Joins with checked cardinality, null-safe keys and left-wins overlaps."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import within_days

CARDINALITIES = ("1:1", "m:1")
KEEPS = ("all", "matched", "left")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def _filler(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    return F.lit(0).cast(dtype)


def _encode(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Split each key in a non-null value and a missing flag.

    Plain equality on the pair matches missing with missing. Compared with ``<=>`` it leaves
    ordinary partitioning attributes, so the uniqueness check, the join and the next join of
    a chain share one shuffle.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    new = {}
    for i, k in enumerate(keys):
        new[f"__k{i}"] = F.coalesce(F.col(k), _filler(types[k]))
        new[f"__m{i}"] = F.col(k).isNull()
    out = df.withColumns(new)
    return out if side == "left" else out.drop(*keys)


def _key_names(keys: Sequence[str]) -> list[str]:
    return [f"__{p}{i}" for i in range(len(keys)) for p in ("k", "m")]


def _decode(df: DataFrame, keys: Sequence[str], others: Sequence[str]) -> DataFrame:
    back = [F.when(~F.col(f"__m{i}"), F.col(f"__k{i}")).alias(k) for i, k in enumerate(keys)]
    return df.select(*back, *[F.col(f"`{c}`") for c in others])


def assert_unique(df: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """Fails the job on the first repeated key.

    The row number runs over the partitioning and order that the sort-merge join on the same
    keys needs anyway, and it streams: no group is held in memory.
    """
    w = Window.partitionBy(*on).orderBy(*on)
    failed = F.raise_error(F.lit(f"key is not unique in the {what} table")).cast("boolean")
    return (
        df.withColumn("__rn", F.row_number().over(w))
        .filter(F.when(F.col("__rn") > 1, failed).otherwise(F.lit(True)))
        .drop("__rn")
    )


@dataclass(frozen=True)
class Side:
    """Right-hand table of a merge chain."""

    df: DataFrame
    card: str = "1:1"
    keep: str = "left"
    known_unique: bool = False
    indicator: str | None = None


def _merge_encoded(left: DataFrame, side: Side, on: list[str], taken: set[str], check_left: bool) -> tuple[DataFrame, list[str]]:
    if side.card not in CARDINALITIES or side.keep not in KEEPS:
        raise ValueError(f"unknown cardinality or keep rule: {side.card}, {side.keep}")
    right = side.df
    fresh = [c for c in right.columns if c not in on and c not in taken]
    right = right.select(*on, *[F.col(f"`{c}`") for c in fresh])
    if not side.known_unique:
        right = assert_unique(right, on, "right")
    if check_left and side.card == "1:1":
        left = assert_unique(left, on, "left")
    if side.indicator:
        left = left.withColumn("__l", F.lit(True))
        right = right.withColumn("__r", F.lit(True))
    if side.keep == "matched":
        out = left.join(right, on, "inner")
    elif side.keep == "left":
        out = left.join(right, on, "left")
    elif side.card == "1:1":
        out = left.join(right, on, "full_outer")
    else:
        # A full outer join cannot split a hot key; a left join plus the unmatched right rows can.
        seen = left.select(*on).distinct()
        rest = right.join(seen, on, "left_anti")
        out = left.join(right, on, "left").unionByName(rest, allowMissingColumns=True)
    if side.indicator:
        both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
        code = F.when(both, 3).when(F.col("__l").isNotNull(), 1).otherwise(2)
        out = out.withColumn(side.indicator, code.cast("int")).drop("__l", "__r")
        fresh = fresh + [side.indicator]
    return out, fresh


def merge_many(
    left: DataFrame, sides: Sequence[Side], keys: Sequence[str], left_unique: bool = False, null_keys: bool = True
) -> DataFrame:
    """Chain of merges on the same keys; the left table is shuffled once for all of them.

    ``null_keys=False`` says that the keys are never missing. They are then joined as they are,
    so a table that was just grouped by them is not shuffled again.
    """
    on = _key_names(keys) if null_keys else list(keys)
    others = [c for c in left.columns if c not in keys]
    out = _encode(left, keys, "left") if null_keys else left
    out = out.select(*on, *[F.col(f"`{c}`") for c in others])
    taken = set(others) | set(keys)
    for side in sides:
        right = _encode(side.df, keys, "right") if null_keys else side.df
        out, fresh = _merge_encoded(out, replace(side, df=right), on, taken, check_left=not left_unique)
        others = others + fresh
        taken |= set(fresh)
        left_unique = left_unique or side.card == "1:1"
    return _decode(out, keys, others) if null_keys else out.select(*keys, *[F.col(f"`{c}`") for c in others])


def merge(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    card: str = "1:1",
    keep: str = "all",
    indicator: str | None = None,
    left_unique: bool = False,
    right_unique: bool = False,
    null_keys: bool = True,
) -> DataFrame:
    """Join two tables on keys.

    * missing keys match each other;
    * a repeated key on a side that has to be unique fails the job, unless the caller says
      the side is unique by construction (it comes from a group-by on the keys);
    * columns the two tables share besides the keys are taken from the left;
    * ``indicator`` adds 1 (left only), 2 (right only), 3 (matched).

    A many-to-one merge that keeps all rows reads the left table twice (join, unmatched keys):
    write it first if it is costly.
    """
    return merge_many(left, [Side(right, card, keep, right_unique, indicator)], keys, left_unique, null_keys)


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    other = set(right.columns)
    return [c for c in left.columns if c in other]


def _keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on keys that are missing on both sides or equal; the left table's other columns come first."""
    others = [c for c in left.columns if c not in on]
    if how.replace("_", "") not in ("semi", "leftsemi", "anti", "leftanti"):
        others += [c for c in right.columns if c not in on]
    if len(set(others)) < len(others):
        raise ValueError("the tables share columns that are not keys")
    joined = _encode(left, on, "right").join(_encode(right, on, "right"), _key_names(on), how)
    return _decode(joined, on, others)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join on every column the two tables share; missing keys match each other."""
    on = common_columns(left, right)
    if not on:
        raise ValueError("the tables share no column")
    return _keyed_join(left, right, on, how)


def join_all(tables: Sequence[DataFrame], on: Sequence[str] | None = None) -> DataFrame:
    """Inner join of many feature tables, left to right; missing keys match each other."""
    if on is None:
        return functools.reduce(natural_join, tables)
    return functools.reduce(lambda a, b: _keyed_join(a, b, list(on), "inner"), tables)


def copy_reference_row(df: DataFrame, entity: str, reference: str, time: str, cols: Sequence[str], prefix: str) -> DataFrame:
    """Give every row of a date the values of the reference entity at that date.

    One reference row per date is kept (the aggregate), so the side has at most as many rows
    as there are dates.
    """
    picked = (
        df.filter(F.col(entity) == reference)
        .groupBy(time)
        .agg(*[F.min(c).alias(prefix + c) for c in cols])
    )
    return df.join(picked, [time], "left")


def first_date_when(df: DataFrame, entity: str, date: str, cond: Column, name: str) -> DataFrame:
    """One row per entity: the first date on which the condition holds, else NULL."""
    return df.groupBy(entity).agg(F.min(F.when(cond, F.col(date))).alias(name))


def max_after_first(
    df: DataFrame, entity: str, date: str, value: str, days: int, name: str, national: bool = False
) -> DataFrame:
    """Largest value within ``days`` of the entity's first positive date; 0 without one.

    ``df`` is read twice (first dates, values): write it first if it is costly.

    ``national=True`` takes the maximum over all entities in the entity's window. The daily
    maximum is formed first, and the window is spelled out as ``days + 1`` dates per entity, so
    the join is an equality on the date.
    """
    first = first_date_when(df, entity, date, F.col(value) > 0, "__first")
    if national:
        daily = df.groupBy(date).agg(F.max(value).alias("__max"))
        spans = first.select(
            entity,
            F.explode_outer(F.sequence("__first", F.date_add("__first", days))).alias(date),
        )
        hit = spans.join(daily, [date], "left").groupBy(entity).agg(F.max("__max").alias(name))
    else:
        rows = df.select(entity, date, value).join(first, [entity])
        inside = within_days(date, "__first", days)
        hit = rows.groupBy(entity).agg(F.max(F.when(inside, F.col(value))).alias(name))
    return hit.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def up_to_event(df: DataFrame, events: DataFrame, entity: str, date: str, event_date: str, days: int) -> DataFrame:
    """Rows dated no later than the entity's event date plus ``days``."""
    side = events.select(entity, event_date)
    return df.join(side, [entity], "inner").filter(F.col(date) <= F.date_add(F.col(event_date), days))
