"""Group statistics, collapses and roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_div, sum_strict, sum_zero
from ..session import materialize
from .joins import merge

STATS = ("sum", "sum_strict", "mean", "sd", "min", "max", "first", "last", "count")


def stat_column(stat: str, col: str, order: str | None = None) -> Column:
    c = F.col(col)
    if stat in ("first", "last") and order is None:
        raise ValueError(f"'{stat}' needs an order column")
    return {
        "sum": lambda: sum_zero(c),
        "sum_strict": lambda: sum_strict(c),
        "mean": lambda: F.avg(c),
        "sd": lambda: F.stddev_samp(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "first": lambda: F.min_by(c, F.col(order)),
        "last": lambda: F.max_by(c, F.col(order)),
        "count": lambda: F.count(c),
    }[stat]()


def collapse(
    df: DataFrame, by: Sequence[str], stats: Mapping[str, str | tuple[str, str]], order: str | None = None
) -> DataFrame:
    """One row per group. ``stats`` maps the output name to a statistic of the column of the
    same name, or to ``(statistic, column)``. First and last follow the ``order`` column."""
    aggs = []
    for name, what in stats.items():
        stat, col = (what, name) if isinstance(what, str) else what
        aggs.append(stat_column(stat, col, order).alias(name))
    return df.groupBy(*by).agg(*aggs)


def two_level(
    df: DataFrame,
    day_keys: Sequence[str],
    period_keys: Sequence[str],
    value: str,
    date: str,
    first_date: str | None = "date",
) -> DataFrame:
    """Sum to entity-days, then mean over the days of the period. ``period_keys`` must be
    functions of the day keys, so they are carried through the first level."""
    extra = [k for k in period_keys if k not in day_keys]
    daily = df.groupBy(*day_keys, *extra).agg(sum_zero(value).alias(value))
    aggs = [F.avg(value).alias(value)]
    if first_date:
        aggs.append(F.min(date).alias(first_date))
    return daily.groupBy(*period_keys).agg(*aggs)


def summarize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with count, mean, sd, min and max of each column."""
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}_n"),
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_sd"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return df.agg(*aggs)


def attach_group_stats(df: DataFrame, by: Sequence[str], stats: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Group statistics on every row, as an aggregate joined back.

    The aggregate combines map-side and a join splits hot keys, so a group of any size is
    never gathered in one task, as a window over it would be. The aggregate is written first, so
    that its size is known when the join is planned and a small one is broadcast without moving the rows.
    ``df`` is read twice: write it first if it is the end of a long pipeline.
    """
    table = materialize(collapse(df, by, stats), "group-stats")
    out = merge(df, table, by, card="m:1", keep="left", right_unique=True)
    return out.select(*[F.col(f"`{c}`") for c in [*df.columns, *stats]])


def share_of_group(df: DataFrame, by: Sequence[str], value: str, name: str, total: str | None = None) -> DataFrame:
    """Value over the strict group total; the total is kept when named."""
    tot = total or "__total"
    out = attach_group_stats(df, by, {tot: ("sum_strict", value)})
    out = out.withColumn(name, safe_div(value, tot))
    return out if total else out.drop("__total")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def one_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in a total order, as an aggregate over ordered structs (it
    combines map-side, so a hot key does not sit in one task)."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [c for c in order if c not in keys] + [c for c in rest if c not in order]
    # A leading missing flag sorts missing values last.
    rank = F.struct(*[x for c in ranked for x in (F.col(c).isNull().alias(f"m_{c}"), F.col(c).alias(c))])
    best = df.groupBy(*keys).agg(F.min(rank).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def code_total(df: DataFrame, by: Sequence[str], code: str, codes: Sequence, value: str, name: str) -> DataFrame:
    """Sum of the rows with the listed codes, per group."""
    return df.groupBy(*by).agg(F.sum(F.when(F.col(code).isin(*codes), F.col(value))).alias(name))


def pooled_rate(df: DataFrame, entity: str, count: str, population: str, n_periods: int, name: str) -> DataFrame:
    """Counts summed over all periods, relative to the population averaged over the periods."""
    agg = df.groupBy(entity).agg(
        (F.sum(population) / F.lit(float(n_periods))).alias(population), F.sum(count).alias("__count")
    )
    return agg.select(entity, population, safe_div("__count", population).alias(name))


def band_rollup(
    df: DataFrame, by: Sequence[str], band: str, value: str, bands: Sequence[str], combined: Mapping[str, Sequence[str]]
) -> DataFrame:
    """One column per band plus sums of bands (missing if one of them is missing)."""
    wide = df.groupBy(*by).pivot(band, list(bands)).agg(F.sum(value))
    sums = {}
    for name, parts in combined.items():
        total = F.col(f"`{parts[0]}`")
        for p in parts[1:]:
            total = total + F.col(f"`{p}`")
        sums[name] = total
    return wide.withColumns(sums)


def argmin_rows(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows at the group's smallest value, ties kept. Groups without a value give no row."""
    low = materialize(df.groupBy(*by).agg(F.min(value).alias("__low")), "lowest")
    out = merge(df, low, by, card="m:1", keep="left", right_unique=True)
    return out.filter(F.col(value) == F.col("__low")).drop("__low")


def row_number_in(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))
