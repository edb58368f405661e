"""Single-model entry points and row-level results."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clean import complete_cases
from ..session import materialize
from .engine import fit_all
from .spec import FitResult, ModelSpec, column_of, label_of


def fit(df: DataFrame, spec: ModelSpec) -> FitResult:
    return fit_all(df, [spec])[0]


def ols(df: DataFrame, y, x, name: str = "ols", **options) -> FitResult:
    return fit(df, ModelSpec(name, y, x, **options))


def tsls(df: DataFrame, y, endog, instruments, exog=(), name: str = "tsls", **options) -> FitResult:
    return fit(df, ModelSpec(name, y, exog, endog, instruments, **options))


def _present(spec: ModelSpec) -> Column:
    cond = F.lit(True)
    for t in spec.columns:
        cond = cond & column_of(t).isNotNull() & ~F.isnan(column_of(t))
    for g in (*spec.entity, *spec.cluster):
        cond = cond & F.col(g).isNotNull()
    if spec.trend:
        cond = cond & F.col(spec.trend[0]).isNotNull()
    return cond


def with_fit(
    df: DataFrame, spec: ModelSpec, fitted: str | None = None, resid: str | None = None
) -> tuple[DataFrame, FitResult]:
    """Adds fitted values and residuals as columns; rows outside the sample stay NULL.

    Without absorbed effects both are linear expressions of literals and columns. With them the
    effects come from one aggregate by entity that is joined back.
    """
    result = fit_all(df, [replace(spec, vce="classical", cluster=())], keep_effects=True)[0]
    linear = F.lit(0.0)
    for t in spec.regressors:
        b = result.coef(label_of(t))
        if not np.isnan(b):
            linear = linear + F.lit(b) * column_of(t)
    names = df.columns
    out = df
    if spec.entity:
        table, plan, (centre, scale) = result.effects
        # Effects are in scaled units of y minus the regressors' shifts.
        offset = plan.shift[0]
        for t in spec.regressors:
            b = result.coef(label_of(t))
            if not np.isnan(b):
                offset -= b * plan.shift[plan.labels.index(label_of(t))]
        effect = F.lit(offset) + F.lit(plan.scale[0]) * F.col("__e0")
        if spec.trend:
            u = (F.col(spec.trend[0]).cast("double") - F.lit(centre)) / F.lit(scale)
            effect = effect + F.lit(plan.scale[0]) * F.col("__e1") * u
            if spec.trend[1] == 2:
                effect = effect + F.lit(plan.scale[0]) * F.col("__e2") * u * u
        out = df.join(table, list(spec.entity), "left")
        linear = linear + effect
    elif spec.constant:
        linear = linear + F.lit(result.coef("_cons"))
    inside = _present(spec)
    new = [F.col(f"`{c}`") for c in names]
    if fitted:
        new.append(F.when(inside, linear).alias(fitted))
    if resid:
        new.append(F.when(inside, column_of(spec.y) - linear).alias(resid))
    return out.select(*new), result


def residualize(df: DataFrame, spec: ModelSpec, name: str) -> DataFrame:
    return with_fit(df, spec, resid=name)[0]


def fitted(df: DataFrame, spec: ModelSpec, name: str) -> DataFrame:
    return with_fit(df, spec, fitted=name)[0]


# -- period effects next to entity effects -------------------------------------

CLOSE = 1e-12
PERIODS = 1_000_000  # periods up to which their vectors are kept on the driver and sent to tasks; beyond, they stay in tables


@dataclass
class _Cells:
    """Rows and sums of an (entity, period) panel, and the right sides of its normal equations net of the entity effects: per period its rows ``np`` and
    r0, r1, …"""

    cells: DataFrame
    entity: list[str]
    totals: DataFrame
    right: DataFrame
    columns: int


def _chain(diagonal: np.ndarray, side: np.ndarray):
    """Solver of the matrix that keeps the couplings of neighbouring periods only. Where a run of neighbours has no other coupling the matrix
    would be singular; the run's first period is then held."""
    d = diagonal.copy()
    free = diagonal - np.append(0.0, side) - np.append(side, 0.0)  # what a period's other couplings add
    starts = np.flatnonzero(np.append(True, side <= 0.0))
    for a, b in zip(starts, [*starts[1:], len(d)]):
        if free[a:b].sum() <= 1e-9 * diagonal[a:b].sum():
            d[a] = 2.0 * d[a] if d[a] > 0 else 1.0
    pivot, below = d.copy(), np.zeros(len(side))
    for i in range(1, len(d)):
        below[i - 1] = side[i - 1] / pivot[i - 1]
        pivot[i] = max(d[i] - below[i - 1] * side[i - 1], 1e-12 * d[i], 1e-300)

    def solve(r: np.ndarray) -> np.ndarray:
        z = r.copy()
        for i in range(1, len(z)):
            z[i] += below[i - 1] * z[i - 1]
        z /= pivot[:, None]
        for i in range(len(z) - 2, -1, -1):
            z[i] += below[i] * z[i + 1]
        return z

    return solve


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods, rows and first places of the entities of a batch."""
    cells = batch.column("cells")
    flat = cells.flatten()
    starts = cells.offsets.to_numpy()[:-1] - cells.offsets.to_numpy()[0]
    return flat.field("at").to_numpy(), flat.field("n").to_numpy(), starts


def _solve_periods(system: _Cells) -> DataFrame:
    """(__p, x0, x1, …): the period effects for every right side, by preconditioned conjugate gradients.

    The matrix is diag(rows per period) less the overlap of periods through entities. An entity's cells are one array row; a step is one scan of these rows
    and one aggregate by period. Vectors have a number per period and right side. The preconditioner has the exact couplings of neighbouring periods, so that a
    panel whose entities live for a few periods each is solved as fast as a balanced one.
    """
    ids = range(system.columns)
    known = system.right.orderBy("__p").collect()  # PERIODS rows at most
    spark, count = system.cells.sparkSession, len(known)
    kind = system.right.schema["__p"].dataType.simpleString()
    numbers = spark.createDataFrame([(r["__p"], i) for i, r in enumerate(known)], f"__p {kind}, at int")
    arrays = system.cells.join(numbers, "__p").groupBy(*system.entity).agg(F.array_sort(F.collect_list(F.struct("at", F.col("n").cast("double").alias("n")))).alias("cells"))
    arrays = materialize(arrays.select("cells"), "entity-cells")

    def summed(rows: DataFrame, width: int) -> np.ndarray:
        out = np.zeros((count, width))
        for r in rows.groupBy("at").agg(*[F.sum(F.col("q")[i]).alias(f"q{i}") for i in range(width)]).collect():  # a row per period
            out[r["at"]] = [r[f"q{i}"] for i in range(width)]
        return out

    def by_period(make, width: int):
        """A scan that sums ``make(at, n, starts, total)``, of shape (cells, width), by period."""

        def run(batches):
            out, seen = np.zeros((count, width)), np.zeros(count, bool)
            for batch in batches:
                if batch.num_rows:
                    at, n, starts = _flat(batch)
                    lengths = np.diff(np.append(starts, len(at)))
                    value = make(at, n, starts, np.repeat(np.add.reduceat(n, starts), lengths), lengths)
                    for i in range(width):
                        out[:, i] += np.bincount(at, value[:, i], count)
                    seen[at] = True
            used = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out[used].tolist(), pa.list_(pa.float64()))], names=["at", "q"])

        return summed(arrays.mapInArrow(run, "at int, q array<double>"), width)

    def couplings(at, n, starts, total, lengths):
        following = np.append(at[1:], -1)
        last = np.zeros(len(at), bool)
        last[starts + lengths - 1] = True
        beside = np.where(~last & (following == at + 1), n * np.append(n[1:], 0.0) / total, 0.0)
        return np.column_stack([n * n / total, beside])

    shared = by_period(couplings, 2)
    rows = np.array([r["np"] for r in known], float)
    solve = _chain(np.maximum(rows - shared[:, 0], 0.0), shared[:-1, 1])

    def product(d: np.ndarray) -> np.ndarray:
        vector = spark.sparkContext.broadcast(d)  # PERIODS rows at most

        def pulled(at, n, starts, total, lengths):
            u = np.add.reduceat(n[:, None] * vector.value[at], starts) / np.add.reduceat(n, starts)[:, None]
            return n[:, None] * np.repeat(u, lengths, axis=0)

        out = rows[:, None] * d - by_period(pulled, system.columns)
        vector.unpersist()
        return out

    r = np.array([[row[f"r{i}"] for i in ids] for row in known], float).reshape(count, system.columns)
    x, first = np.zeros_like(r), (r * r / rows[:, None]).sum(axis=0)
    z = solve(r)
    d, left = z.copy(), (r * z).sum(axis=0)
    best, idle = np.full(system.columns, np.inf), 0
    while idle < 50:  # ends at rounding: fifty steps without progress
        now = (r * r / rows[:, None]).sum(axis=0)
        going = now > CLOSE**2 * first
        if not going.any():
            break
        idle = 0 if (now < 0.99 * best)[going].any() else idle + 1
        best = np.minimum(best, now)
        q = product(np.where(going, d, 0.0))
        curve = (d * q).sum(axis=0)
        step = np.where(going & (curve > 0), left / np.where(curve > 0, curve, 1.0), 0.0)
        x, r = x + step * d, r - step * q
        z = solve(r)
        after = (r * z).sum(axis=0)
        d, left = z + np.where(left > 0, after / np.where(left > 0, left, 1.0), 0.0) * d, after
    else:
        if (now > 1e-12 * first).any():
            raise ArithmeticError("period effects do not converge")
    return spark.createDataFrame([(row["__p"], *map(float, x[i])) for i, row in enumerate(known)], f"__p {kind}, " + ", ".join(f"x{i} double" for i in ids))


def _solve_in_tables(system: _Cells, periods: int) -> DataFrame:
    """The same by plain conjugate gradients whose vectors stay in written tables: two joins and two aggregates of the cells a step."""
    ids, cells, entity = range(system.columns), system.cells, system.entity
    state = system.right.select(
        "__p", "np", *[f"r{i}" for i in ids], *[(F.col(f"r{i}") / F.col("np")).alias(f"d{i}") for i in ids], *[F.lit(0.0).alias(f"x{i}") for i in ids]
    )
    state = materialize(state, "periods")

    def sums(df: DataFrame, product) -> list[float]:
        got = df.agg(*[F.sum(product(i)).alias(f"s{i}") for i in ids]).first()
        return [float(got[f"s{i}"] or 0.0) for i in ids]

    left = sums(state, lambda i: F.col(f"r{i}") * F.col(f"r{i}") / F.col("np"))
    start = list(left)
    for _ in range(2 * periods):
        if all(now <= CLOSE**2 * first for now, first in zip(left, start)):
            break
        near = (
            cells.select(*entity, "__p", "n").join(state.select("__p", *[f"d{i}" for i in ids]), "__p")
            .groupBy(*entity).agg(*[(F.sum(F.col("n") * F.col(f"d{i}")) / F.sum("n")).alias(f"u{i}") for i in ids])
        )
        pulled = cells.select(*entity, "__p", "n").join(near, list(entity)).groupBy("__p").agg(*[F.sum(F.col("n") * F.col(f"u{i}")).alias(f"q{i}") for i in ids])
        both = materialize(
            state.join(pulled, "__p").select(*state.columns, *[(F.col("np") * F.col(f"d{i}") - F.col(f"q{i}")).alias(f"q{i}") for i in ids]), "step"
        )
        curve = sums(both, lambda i: F.col(f"d{i}") * F.col(f"q{i}"))
        step = [now / c if c > 0 and now > CLOSE**2 * first else 0.0 for now, c, first in zip(left, curve, start)]
        moved = both.select(
            "__p", "np",
            *[(F.col(f"r{i}") - F.lit(step[i]) * F.col(f"q{i}")).alias(f"r{i}") for i in ids],
            *[f"d{i}" for i in ids],
            *[(F.col(f"x{i}") + F.lit(step[i]) * F.col(f"d{i}")).alias(f"x{i}") for i in ids],
        )
        after = sums(moved, lambda i: F.col(f"r{i}") * F.col(f"r{i}") / F.col("np"))
        turn = [a / b if b > 0 else 0.0 for a, b in zip(after, left)]
        state = materialize(moved.withColumns({f"d{i}": F.col(f"r{i}") / F.col("np") + F.lit(turn[i]) * F.col(f"d{i}") for i in ids}), "periods")
        left = after
    return state.select("__p", *[f"x{i}" for i in ids])


@dataclass
class TwoWay:
    """Complete rows with entity and period effects taken out of every model column, the model for them, and what the constant needs.

    ``levels``: each column's level at the base entity and period (the smallest keys); ``weight``: the column whose coefficient carries the
    constant's sampling error, orthogonal to all others."""

    rows: DataFrame
    spec: ModelSpec
    total: float
    levels: dict[str, float]
    weight: str


def remove_two_way(df: DataFrame, spec: ModelSpec, period: str) -> TwoWay:
    """Exact entity and period effects taken out of every column of ``spec``."""
    labels = [label_of(t) for t in spec.columns]
    cols = [f"__w{i}" for i in range(len(labels))]
    entity = list(spec.entity)
    if not entity:
        raise ValueError("without an entity effect the period can be absorbed as the entity")
    rows = df.select(
        *dict.fromkeys((*spec.entity, *spec.cluster)), F.col(period).alias("__p"), *[column_of(t).alias(c) for t, c in zip(spec.columns, cols)]
    )
    rows = materialize(complete_cases(rows, rows.columns), "two-way")
    # Centred, so that sums over cells keep the digits of the variation.
    facts = rows.agg(
        F.countDistinct("__p").alias("periods"), F.countDistinct(*entity).alias("entities"), F.count(F.lit(1)).alias("n"), F.var_pop(cols[0]).alias("var"),
        F.min("__p").alias("period"), F.min(F.struct(*entity)).alias("entity"), *[F.avg(c).alias(c) for c in cols],
    ).first()
    if not facts["n"]:
        raise ValueError(f"model {spec.name}: no complete row")
    centred = {c: F.col(c) - F.lit(facts[c]) for c in cols}
    cells = materialize(rows.groupBy(*entity, "__p").agg(F.count(F.lit(1)).alias("n"), *[F.sum(centred[c]).alias(c) for c in cols]), "cells")
    totals = materialize(cells.groupBy(*entity).agg(F.sum("n").alias("__n"), *[(F.sum(c) / F.sum("n")).alias(f"m{c}") for c in cols]), "entity-means")
    in_base = F.lit(True)
    for e in entity:
        in_base = in_base & (F.col(e) == F.lit(facts["entity"][e]))
    # The last right side asks for the rows' weights in the level at the base entity and period.
    here = F.when(F.col("__p") == F.lit(facts["period"]), F.lit(1.0)).otherwise(F.lit(0.0))
    right = (
        cells.join(totals, entity)
        .groupBy("__p")
        .agg(
            F.sum("n").alias("np"), *[F.sum(F.col(c) - F.col("n") * F.col(f"m{c}")).alias(f"r{i}") for i, c in enumerate(cols)],
            F.sum(F.when(in_base, F.col("n") / F.col("__n")).otherwise(F.lit(0.0))).alias("b"),
        )
        .withColumn(f"r{len(cols)}", here - F.col("b"))
        .drop("b")
    )
    system = _Cells(cells, entity, totals, materialize(right, "right"), len(cols) + 1)
    few = facts["periods"] <= PERIODS
    effects = _solve_periods(system) if few else _solve_in_tables(system, facts["periods"])
    names = [*cols, "__h"]
    effects = materialize(effects.select("__p", *[F.col(f"x{i}").alias(f"d{c}") for i, c in enumerate(names)]), "period-effects")
    # Entity effects given the period effects.
    mean = cells.join(effects, "__p").groupBy(*entity).agg(*[(F.sum(F.col("n") * F.col(f"d{c}")) / F.sum("n")).alias(f"e{c}") for c in names])
    found = totals.join(mean, entity).select(
        *entity, *[(F.col(f"m{c}") - F.col(f"e{c}")).alias(f"a{c}") for c in cols],
        (F.when(in_base, 1.0 / F.col("__n")).otherwise(F.lit(0.0)) - F.col("e__h")).alias("a__h"),
    )
    found = materialize(found, "entity-effects")
    joined = rows.join(effects, "__p").join(found, entity)
    cleaned = joined.withColumns(
        {c: centred[c] - F.col(f"d{c}") - F.col(f"a{c}") for c in cols} | {"__h": F.col("d__h") + F.col("a__h")}
    )
    own = found.where(in_base).first()
    first = effects.where(F.col("__p") == F.lit(facts["period"])).first()
    levels = {la: float(facts[c] + own[f"a{c}"] + first[f"d{c}"]) for la, c in zip(labels, cols)}
    back = dict(zip(labels, cols))

    def moved(terms: Sequence):
        return tuple((label_of(t), F.col(back[label_of(t)])) for t in terms)

    new = replace(
        spec, y=(label_of(spec.y), F.col(back[label_of(spec.y)])), x=moved(spec.x), endog=moved(spec.endog), instruments=moved(spec.instruments),
        entity=(), constant=False, extra_k=spec.extra_k + facts["entities"] + facts["periods"] - 1,
    )
    return TwoWay(materialize(cleaned.select(*dict.fromkeys((*entity, *spec.cluster)), "__p", *cols, "__h"), "cleaned"), new, float(facts["var"] * facts["n"]), levels, "__h")


def fit_two_way(df: DataFrame, spec: ModelSpec, period: str) -> FitResult:
    """Model with entity and period effects. R² counts both kinds of effects as explained. The constant is the level at the
    base entity and period, the smallest keys."""
    two = remove_two_way(df, spec, period)
    inner = two.spec
    if spec.constant:
        # h is the constant's row weights; r = h / h'h is the constant net of all other effects. It is orthogonal to the cleaned columns,
        # so its coefficient is zero, and its row of the covariance is the error of the level.
        size = two.rows.agg(F.sum(F.col(two.weight) * F.col(two.weight))).first()[0]
        inner = replace(inner, x=(*inner.x, ("_cons", F.col(two.weight) / F.lit(size))), extra_k=inner.extra_k - 1)
    result = fit(two.rows, inner)
    if spec.constant:
        turn = np.eye(len(result.terms))
        at = result.index("_cons")
        for i, t in enumerate(result.terms):
            if i != at and not math.isnan(result.beta[i]):
                turn[at, i] = -two.levels[t]
        known = ~np.isnan(result.beta)
        result.beta[at] = two.levels[label_of(spec.y)] + turn[at, known] @ result.beta[known]
        cov = np.where(np.isnan(result.cov), 0.0, result.cov)
        dead = np.isnan(result.cov)
        result.cov = np.where(dead, np.nan, turn @ cov @ turn.T)
    result.spec = replace(spec, extra_k=inner.extra_k)
    free = result.n - result.k
    result.r2 = 1.0 - result.rss / two.total if two.total > 0 else math.nan
    result.adj_r2 = 1.0 - (1.0 - result.r2) * (result.n - 1) / free if free > 0 else math.nan
    return result
