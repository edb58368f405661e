"""Ordered panel functions: lags, differences, indexes, fills, step panels, ids."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import days_between, safe_div, safe_ln
from ..session import materialize
from .aggregates import argmin_rows, attach_group_stats
from .joins import assert_unique, merge
from .reshape import calendar

_LAST_BLOCK = 2**62


@dataclass(frozen=True)
class Panel:
    """A table with an entity key and a time key, unique together.

    Because the pair is unique, an entity has at most as many rows as there are periods, and
    an ordered window over an entity is bounded by the calendar. ``block`` (periods per block)
    cuts long histories: each entity is then processed in blocks, with the last rows of the
    blocks before carried over, so one entity's history spreads over many tasks.
    """

    df: DataFrame
    entity: tuple[str, ...]
    time: tuple[str, ...]
    block: int | None = None
    order: tuple[Column, ...] = field(init=False, compare=False)

    def __post_init__(self):
        for name in ("entity", "time"):
            value = getattr(self, name)
            if isinstance(value, str):
                object.__setattr__(self, name, (value,))
        object.__setattr__(self, "order", tuple(F.col(t).asc_nulls_last() for t in self.time))

    def with_df(self, df: DataFrame) -> Panel:
        return replace(self, df=df)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.entity).orderBy(*self.order)

    def unique(self) -> Panel:
        """The same panel, whose use fails on the first repeated (entity, time) pair. The streaming check runs over
        the partitioning that the ordered functions need anyway."""
        return self.with_df(assert_unique(self.df, [*self.entity, *self.time], "panel"))

    def blocked(self) -> DataFrame:
        """Rows with the number ``__b`` of their block of ``block`` periods. Periods are numbered by the dense rank of
        the distinct time keys, whatever their types; rows without a time key form the last block."""
        cond = F.lit(True)
        for t in self.time:
            cond = cond & F.col(t).isNotNull()
        periods = _numbered(self.df.select(*self.time).where(cond).distinct(), self.time, "__at")
        periods = materialize(periods, "periods")
        numbered = self.df.join(periods, list(self.time), "left")
        block = F.floor((F.col("__at") - 1) / F.lit(self.block)).cast("long")
        return numbered.select(*[F.col(f"`{c}`") for c in self.df.columns], F.coalesce(block, F.lit(_LAST_BLOCK)).alias("__b"))


def over_rows(panel: Panel, reach: int, build: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """Run ``build(df, window)`` on rows that can see ``reach`` rows back in their entity."""
    if panel.block is None:
        return build(panel.df, panel.window())

    names = panel.df.columns
    blocked = panel.blocked()
    inside = [*panel.entity, "__b"]
    backwards = Window.partitionBy(*inside).orderBy(*[F.col(t).desc_nulls_first() for t in panel.time])
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    # Last rows of each block: at most `reach` per entity and block.
    tails = (
        blocked.withColumn("__rn", F.row_number().over(backwards))
        .filter(F.col("__rn") <= reach)
        .groupBy(*inside)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("__rn")).alias("at"), row))).alias("__tail"))
    )
    # Every block has at least one row, so the `reach` blocks before hold enough rows.
    before = Window.partitionBy(*panel.entity).orderBy("__b").rowsBetween(-reach, -1)
    seen = F.flatten(F.collect_list("__tail").over(before))
    carried = tails.withColumn("__seen", seen).select(
        *panel.entity,
        "__b",
        F.explode(F.slice("__seen", F.greatest(F.size("__seen") - reach + 1, F.lit(1)), reach)).alias("__c"),
    )
    context = carried.select(
        *[F.col(f"__c.row.`{c}`").alias(c) for c in names], "__b", F.lit(True).alias("__ctx")
    )
    both = blocked.withColumn("__ctx", F.lit(False)).unionByName(context)
    window = Window.partitionBy(*inside).orderBy(*panel.order)
    return build(both, window).filter(~F.col("__ctx")).drop("__ctx", "__b")


def lag_by(panel: Panel, cols: Sequence[str], ks: Sequence[int] = (1,)) -> DataFrame:
    """Columns ``{c}_m{k}``: the value k rows earlier in the entity."""

    def build(df, w):
        return df.withColumns({f"{c}_m{k}": F.lag(c, k).over(w) for c in cols for k in ks})

    return over_rows(panel, max(ks), build)


def lag_calendar(panel: Panel, cols: Sequence[str], k: int) -> DataFrame:
    """Columns ``{c}_m{k}`` by calendar distance: NULL where the period k back has no row."""
    (t,) = panel.time
    is_date = isinstance(panel.df.schema[t].dataType, T.DateType)
    later = F.date_add(F.col(t), k) if is_date else F.col(t) + F.lit(k)
    past = panel.df.select(
        *panel.entity, later.cast(panel.df.schema[t].dataType).alias(t), *[F.col(c).alias(f"{c}_m{k}") for c in cols]
    )
    keys = [*panel.entity, t]
    out = merge(panel.df, past, keys, card="1:1", keep="left", left_unique=True, right_unique=True)
    return out.select(*panel.df.columns, *[f"{c}_m{k}" for c in cols])


def difference(panel: Panel, cols: Sequence[str]) -> DataFrame:
    def build(df, w):
        return df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in cols})

    return over_rows(panel, 1, build)


def log_difference(panel: Panel, cols: Sequence[str]) -> DataFrame:
    def build(df, w):
        return df.withColumns({f"d_log_{c}": safe_ln(c) - safe_ln(F.lag(c).over(w)) for c in cols})

    return over_rows(panel, 1, build)


def lagged_differences(panel: Panel, cols: Sequence[str], ks: Sequence[int], scale: float = 1.0) -> DataFrame:
    """Columns ``d_{c}_m{k}``: the first difference k rows earlier, divided by ``scale``."""

    def build(df, w):
        out = {}
        for c in cols:
            for k in ks:
                d = F.lag(c, k).over(w) - F.lag(c, k + 1).over(w)
                out[f"d_{c}_m{k}"] = d if scale == 1.0 else d / F.lit(scale)
        return df.withColumns(out)

    return over_rows(panel, max(ks) + 1, build)


def panel_features(panel: Panel, cols: Sequence[str], lags: int = 5) -> DataFrame:
    """Difference, log difference and their lags for a list of variables.

    Adds for each variable ``d_x``, ``d_log_x`` and, for k = 1..lags, ``x_m{k}``, ``d_x_m{k}``
    and ``d_log_x_m{k}``. All lags share one window: one shuffle and one sort.
    """

    def build(df, w):
        keep = df.columns
        shifted = df.withColumns(
            {f"__{c}_{k}": F.lag(c, k).over(w) for c in cols for k in range(1, lags + 2)}
        )

        def at(c, k):
            return F.col(f"`{c}`") if k == 0 else F.col(f"`__{c}_{k}`")

        out = [F.col(f"`{c}`") for c in keep]
        for c in cols:
            logs = {k: safe_ln(at(c, k)) for k in range(lags + 2)}
            out.append((at(c, 0) - at(c, 1)).alias(f"d_{c}"))
            out.append((logs[0] - logs[1]).alias(f"d_log_{c}"))
            for k in range(1, lags + 1):
                out.append(at(c, k).alias(f"{c}_m{k}"))
                out.append((at(c, k) - at(c, k + 1)).alias(f"d_{c}_m{k}"))
                out.append((logs[k] - logs[k + 1]).alias(f"d_log_{c}_m{k}"))
        return shifted.select(*out)

    return over_rows(panel, lags + 1, build)


def changes(panel: Panel, cols: Mapping[str, tuple[str, str]], across_entities: bool = False) -> DataFrame:
    """Percent and log change against the row before: ``{col: (pct_name, log_name)}``.

    ``across_entities=True`` follows the ordered table without regard to entities: the first
    row of an entity is compared with the last row of the entity before it.
    """

    def build(df, w):
        return df.withColumns({f"__prev_{c}": F.lag(c).over(w) for c in cols})

    df = over_rows(panel, 1, build)
    if across_entities:
        (entity,) = panel.entity
        ids = dense_ids(panel.df, entity, "__id")
        time = F.struct(*panel.time)
        first = F.coalesce(F.min(F.when(functools.reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in panel.time]), time)), F.min(time))
        ends = materialize(panel.df.groupBy(entity).agg(first.alias("__first"), *[F.max_by(c, time).alias(f"__last_{c}") for c in cols]), "entity-ends")
        shifted = (
            ends.join(ids, [entity])
            .select((F.col("__id") + 1).alias("__id"), *[f"__last_{c}" for c in cols])
            .join(ids, ["__id"])
            .drop("__id")
        )
        opens = time.eqNullSafe(F.col("__first"))
        df = df.join(ends.select(entity, "__first"), [entity], "left").join(shifted, [entity], "left").withColumns(
            {f"__prev_{c}": F.when(opens, F.col(f"__last_{c}")).otherwise(F.col(f"__prev_{c}")) for c in cols}
        )
    out = {}
    for c, (pct, log) in cols.items():
        prev = F.col(f"__prev_{c}")
        out[pct] = safe_div(F.col(c) - prev, prev)
        out[log] = safe_ln(c) - safe_ln(prev)
    return df.withColumns(out).select(*panel.df.columns, *out)


def chain_index(df: DataFrame, by: Sequence[str], order: Sequence[str], growth: Mapping[str, str]) -> DataFrame:
    """Chained index minus 1: the group's first row is 0, then the product of (1 + growth).

    A missing growth leaves the rest of the group missing. ``growth`` maps input to output
    columns. Groups are short runs by construction (the days of one entity's week).
    """
    w = Window.partitionBy(*by).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(w) == 1
    steps = df.withColumns({f"__g_{o}": F.when(first, F.lit(1.0)).otherwise(1 + F.col(g)) for g, o in growth.items()})
    out = {}
    for o in growth.values():
        broken = F.count(F.when(F.col(f"__g_{o}").isNull(), 1)).over(running) > 0
        out[o] = F.when(~broken, F.product(F.col(f"__g_{o}")).over(running) - 1)
    return steps.withColumns(out).drop(*[f"__g_{o}" for o in growth.values()])


def fill_forward(panel: Panel, cols: Sequence[str]) -> DataFrame:
    """Replace missing values with the entity's last value before them."""
    if panel.block is None:
        w = panel.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return panel.df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    names = panel.df.columns
    df = panel.blocked()
    inside = [*panel.entity, "__b"]
    at = F.struct(*panel.time)
    ends = df.groupBy(*inside).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"__e_{c}") for c in cols]
    )
    before = Window.partitionBy(*panel.entity).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*inside, *[F.last(f"__e_{c}", ignorenulls=True).over(before).alias(f"__p_{c}") for c in cols])
    w = Window.partitionBy(*inside).orderBy(*panel.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = df.withColumns({f"__f_{c}": F.last(c, ignorenulls=True).over(w) for c in cols})
    out = filled.join(carry, inside, "left").withColumns({c: F.coalesce(f"__f_{c}", f"__p_{c}") for c in cols})
    return out.select(*[F.col(f"`{c}`") for c in names])


def zscore_panel(panel: Panel, cols: Mapping[str, str]) -> DataFrame:
    """Z-scores within the entity in one scan: a panel's entity has one row per period, so the
    window is bounded by the calendar and shares its shuffle with the ordered functions. With ``block`` no entity is gathered: its mean and
    spread come from an aggregate."""
    if panel.block is not None:
        return zscore_by(panel.df, list(panel.entity), cols)
    w = Window.partitionBy(*panel.entity)
    new = {o: safe_div(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)) for c, o in cols.items()}
    return panel.df.withColumns(new)


def zscore_by(df: DataFrame, by: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """Group z-scores ``{column: output}`` over groups of any size; missing for a constant or
    one-row group. ``df`` is read twice (statistics, rows): write it first if it is costly."""
    stats = {}
    for c in cols:
        stats[f"__m_{c}"] = ("mean", c)
        stats[f"__s_{c}"] = ("sd", c)
    out = attach_group_stats(df, by, stats)
    new = {o: safe_div(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c, o in cols.items()}
    return out.withColumns(new).drop(*stats)


def zscore(df: DataFrame, cols: Mapping[str, str], strict: bool = False) -> DataFrame:
    """Global z-scores. With ``strict`` one missing value makes the whole column missing."""
    stats = []
    for c in cols:
        whole = F.count(c) == F.count(F.lit(1)) if strict else F.lit(True)
        stats.append(F.when(whole, F.avg(c)).alias(f"m_{c}"))
        stats.append(F.when(whole, F.stddev_samp(c)).alias(f"s_{c}"))
    scalars = df.agg(F.struct(*stats).alias("stats")).scalar()
    return df.withColumns({o: safe_div(F.col(c) - scalars[f"m_{c}"], scalars[f"s_{c}"]) for c, o in cols.items()})


def _numbered(values: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Distinct rows numbered from 1 in sorted order: sorted ranges are written, counted per range, and numbered with
    the range's offset, so no task holds more than its range."""
    ranged = values.repartitionByRange(*cols).withColumn("__p", F.spark_partition_id())
    ranged = materialize(ranged, "ids")
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = counts.select("__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__o"))
    w = Window.partitionBy("__p").orderBy(*cols)
    return ranged.join(offsets, ["__p"]).select(*cols, (F.row_number().over(w) + F.col("__o")).cast("int").alias(name))


def dense_ids(df: DataFrame, col: str, name: str) -> DataFrame:
    """Table (entity, id) numbering the distinct entities 1..N in sorted order."""
    return _numbered(df.select(col).filter(F.col(col).isNotNull()).distinct(), [col], name)


def with_dense_id(df: DataFrame, col: str, name: str) -> DataFrame:
    """Adds the id; ``df`` is read twice, so it should be a written table."""
    ids = materialize(dense_ids(df, col, name), "ids")
    return df.join(ids, [col], "left").select(*df.columns, name)


def shift_share(panel: Panel, share: str, national: str, name: str) -> DataFrame:
    """Predicted growth from an entity's lagged share of a cause and the national fraction of
    that cause: share·growth(fraction) + (1 − share)·growth(1 − fraction); 0 where the national
    fraction is 0 now and one row before."""

    def build(df, w):
        s = F.lag(share).over(w)
        f0, f1 = F.lag(national).over(w), F.col(national)
        own = s * safe_div(f1 - f0, f0)
        rest = (1 - s) * safe_div((1 - f1) - (1 - f0), 1 - f0)
        return df.withColumn(name, F.when((f1 == 0) & (f0 == 0), F.lit(0.0)).otherwise(own + rest))

    return over_rows(panel, 1, build)


def shift_share_levels(panel: Panel, share: str, cause: str, other: str, name: str) -> DataFrame:
    """The same from national levels of the cause and of all other causes. Where the lagged
    share is 0 only the second term counts (its first term may be undefined)."""

    def build(df, w):
        s = F.lag(share).over(w)

        def growth(c):
            before = F.lag(c).over(w)
            return safe_div(F.col(c) - before, before)

        rest = (1 - s) * growth(other)
        return df.withColumn(name, F.when(s == 0, rest).otherwise(s * growth(cause) + rest))

    return over_rows(panel, 1, build)


def step_panel(
    events: DataFrame,
    entity: str,
    policy: str,
    enacted: str,
    policies: Sequence[str],
    start: date,
    end: date,
    counts: Column | None = None,
    day: str = "date",
) -> DataFrame:
    """Daily 0/1 columns per policy: 0 before the first enactment that counts, 1 from it on.

    The first dates of all policies come from one aggregate per entity; the calendar is then
    spelled out per entity. Entities that never adopt get zeros. A missing entity is kept, as
    the reference table keeps every entity it lists.
    """
    valid = F.lit(True) if counts is None else counts
    first = events.groupBy(entity).agg(
        *[F.min(F.when((F.col(policy) == p) & valid, F.col(enacted))).alias(p) for p in policies]
    )
    days = calendar(first, start, end, day)
    flags = [F.coalesce((F.col(day) >= F.col(f"`{p}`")).cast("int"), F.lit(0)).alias(p) for p in policies]
    return days.select(day, entity, *flags)


def step_panel_long(
    events: DataFrame, entity: str, policy: str, enacted: str, policies: Sequence[str], start: date, end: date
) -> DataFrame:
    """The same with one row per entity, policy and day."""
    first = events.groupBy(entity).agg(
        *[F.min(F.when(F.col(policy) == p, F.col(enacted))).alias(p) for p in policies]
    )
    long = first.unpivot([entity], [F.col(f"`{p}`") for p in policies], policy, "__d")
    days = calendar(long, start, end, "date")
    flag = F.coalesce((F.col("date") >= F.col("__d")).cast("int"), F.lit(0))
    return days.select("date", entity, policy, flag.alias("implemented"))


def delay_rows(
    policies: DataFrame,
    entity: str,
    policy: str,
    issued: str,
    first_case: str,
    first_death: str,
    us_case: date,
    us_death: date,
) -> DataFrame:
    """First-issued rows per entity and policy (ties kept) with the days since four marks."""
    first = argmin_rows(policies, [entity, policy], issued)
    marks = {
        "ndays_first_case": F.col(first_case),
        "ndays_first_death": F.col(first_death),
        "ndays_first_uscase": F.lit(us_case),
        "ndays_first_usdeath": F.lit(us_death),
    }
    return first.withColumns({name: days_between(issued, mark) for name, mark in marks.items()})


DELAY_COLUMNS = ("ndays_first_case", "ndays_first_death", "ndays_first_uscase", "ndays_first_usdeath")


def delay_index(rows: DataFrame, entity: str) -> DataFrame:
    """Mean delay over an entity's policies; missing if one of its delays is missing."""
    return rows.groupBy(entity).agg(
        *[F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(c) for c in DELAY_COLUMNS]
    )


def demean(df: DataFrame, by: Sequence[str], cols: Sequence[str], suffix: str = "_dm") -> DataFrame:
    """Within transform: value minus group mean."""
    out = attach_group_stats(df, by, {f"__m_{c}": ("mean", c) for c in cols})
    return out.withColumns({f"{c}{suffix}": F.col(c) - F.col(f"__m_{c}") for c in cols}).drop(
        *[f"__m_{c}" for c in cols]
    )
