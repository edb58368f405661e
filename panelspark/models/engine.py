"""Fits many linear models over one panel with a fixed number of Spark jobs.

All models of a batch are stacked: each input row yields one row per model on whose
complete-case sample it lies, with the model's columns in numbered slots. Then

1. one scan gives a rough centre and scale of every column used (for conditioning);
2. one aggregate by (model, group) gives counts, sums and cross-products of the slots, where
   the group is the absorbed entity or the cluster. Fixed effects and entity trends are
   removed from this group table by sweeping the group's own cross-products, so no row-sized
   table is demeaned, joined or shuffled;
3. sums of the group table by model go to the driver (slots² numbers per model), which solves;
4. the covariance needs sums of squared scores. With clusters they follow from the same group
   table; heteroskedasticity-robust forms take one more scan of the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .spec import FitResult, ModelSpec, column_of, label_of

Vectors = Callable[[FitResult], dict[str, np.ndarray]]
PIVOT_TOL = 1e-9
ABSORB_TOL = 1e-12
ROUNDING = 1e-14


# -- stacking -----------------------------------------------------------------


@dataclass
class _Plan:
    """Slot layout of one model: shift and scale per slot, positions of its parts."""

    spec: ModelSpec
    labels: list[str]
    shift: list[float]
    scale: list[float]
    endog: list[int]
    exog: list[int]
    instr: list[int]


class _Batch:
    """Models that share their group columns."""

    def __init__(self, specs: Sequence[ModelSpec], group: tuple[str, ...]):
        self.specs = list(specs)
        self.group = group
        self.width = max(len(s.columns) for s in specs)
        self.degree = max((s.trend[1] if s.trend else 0) for s in specs)
        self.p = self.width + self.degree
        self.absorbed = any(s.entity for s in specs)
        self.plans: list[_Plan] = []


def _key(term):
    """Identity of a term: its column name, or its label and expression."""
    return term if isinstance(term, str) else (term[0], str(term[1]))


def _distinct_columns(specs: Sequence[ModelSpec]) -> dict:
    out = {}
    for s in specs:
        for t in s.columns:
            key = _key(t)
            if key not in out:
                out[key] = column_of(t)
        if s.trend and s.trend[0] not in out:
            out[s.trend[0]] = column_of(s.trend[0])
    return out


def _centre_and_scale(rows: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and spread of each column."""
    aggs = [a for c in names for a in (F.avg(c).alias(f"m{c}"), F.stddev_pop(c).alias(f"s{c}"))]
    got = rows.agg(*aggs).first()
    out = {}
    for c in names:
        m, s = got[f"m{c}"], got[f"s{c}"]
        m = 0.0 if m is None else float(m)
        s = 1.0 if s is None or s == 0.0 or s < 1e-14 * abs(m) else float(s)
        out[c] = (m, s)
    return out


def _stack(rows: DataFrame, batch: _Batch, names: dict, scales: dict) -> DataFrame:
    """One output row per input row and model with the model's columns in slots v0, v1, …

    The layouts are data, a constant array of column positions, shifts and scales: the generated
    code stays the same size whatever the number of models, so it is always compiled.
    """
    values: list = [F.lit(0.0)]  # position 0 pads unused slots
    at: dict = {}

    def position(key, column):
        if key not in at:
            at[key] = len(values)
            values.append(column)
        return at[key]

    layouts = []
    for i, spec in enumerate(batch.specs):
        free = spec.constant or bool(spec.entity)  # a constant in the span allows any shift
        labels, shift, scale, where = [], [], [], []
        for t in spec.columns:
            c = names[_key(t)]
            m, s = scales[c]
            labels.append(label_of(t))
            shift.append(m if free else 0.0)
            scale.append(s)
            where.append(position(c, c))
        pad = batch.width - len(labels)
        trend = []
        if spec.trend:
            c = names[_key(spec.trend[0])]
            u = (F.col(c) - F.lit(scales[c][0])) / F.lit(scales[c][1])
            power = u
            for d in range(spec.trend[1]):
                trend.append(position((c, d), power))
                power = power * u
        where += [0] * pad + trend + [0] * (batch.degree - len(trend))
        fill = batch.p - len(labels)
        layouts.append(
            {"model": i}
            | {f"i{j}": w for j, w in enumerate(where)}
            | {f"m{j}": m for j, m in enumerate(shift + [0.0] * fill)}
            | {f"r{j}": 1.0 / s for j, s in enumerate(scale + [1.0] * fill)}
        )
        n_e, n_x = len(spec.endog), len(spec.x)
        batch.plans.append(
            _Plan(
                spec,
                labels,
                shift,
                scale,
                endog=list(range(1, 1 + n_e)),
                exog=list(range(1 + n_e, 1 + n_e + n_x)),
                instr=list(range(1 + n_e + n_x, len(labels))),
            )
        )
    keys = _all_keys(batch)
    base = rows.na.drop(subset=keys) if keys else rows
    slots = range(batch.p)
    fields = ["model int", *[f"i{j} int" for j in slots], *[f"m{j} double" for j in slots], *[f"r{j} double" for j in slots]]
    # One literal, folded to a constant array when the plan is made.
    layout = F.from_json(F.lit(json.dumps(layouts)), f"array<struct<{','.join(f.replace(' ', ':') for f in fields)}>>")
    # The array is built in a projection of its own, below the explode: once per input row.
    wide = base.select(*keys, F.array(*values).alias("x")).select(*keys, "x", F.explode(layout).alias("l"))
    slots = [
        ((F.get("x", F.col(f"l.i{j}")) - F.col(f"l.m{j}")) * F.col(f"l.r{j}")).alias(f"v{j}") for j in range(batch.p)
    ]
    stacked = wide.select(*keys, F.col("l.model").alias("model"), *slots)
    present = F.lit(True)
    for j in range(batch.p):
        present = present & F.col(f"v{j}").isNotNull()
    return stacked.filter(present)


def _all_keys(batch: _Batch) -> list[str]:
    keys = list(batch.group)
    for s in batch.specs:
        keys += [g for g in (*s.entity, *s.cluster) if g not in keys]
    return keys


# -- group table --------------------------------------------------------------


def _pairs(p: int):
    return [(i, j) for i in range(p) for j in range(i, p)]


def _at(prefix: str, i: int, j: int) -> str:
    """Name of the cell (i, j) of a symmetric matrix kept as its upper triangle."""
    return f"{prefix}_{min(i, j)}_{max(i, j)}"


def _model_in(members: Sequence[int]) -> str:
    return f"model IN ({', '.join(map(str, members))})" if members else "false"


def _group_moments(stacked: DataFrame, group: Sequence[str], p: int, absorbed: bool) -> DataFrame:
    """Counts, sums and cross-products by group. For absorbed groups the co-moments about the group's own means (``C``) are
    aggregated, which stays exact however far apart the groups lie; the raw cross-products follow from them."""
    aggs = [F.expr("count(1) AS n")]
    aggs += [F.expr(f"sum(v{i}) AS s_{i}") for i in range(p)]
    if not absorbed:
        aggs += [F.expr(f"sum(v{i} * v{j}) AS S_{i}_{j}") for i, j in _pairs(p)]
        return stacked.groupBy("model", *group).agg(*aggs)
    aggs += [F.expr(f"count(1) * covar_pop(v{i}, v{j}) AS C_{i}_{j}") for i, j in _pairs(p)]
    table = stacked.groupBy("model", *group).agg(*aggs)
    return table.selectExpr("*", *[f"C_{i}_{j} + s_{i} * s_{j} / n AS S_{i}_{j}" for i, j in _pairs(p)])


def _absorb(table: DataFrame, batch: _Batch) -> DataFrame:
    """Adds A_i_j, the cross-products net of the model's absorbed effects, the number of effects
    (``rank``), per slot the mean and the trend slopes that were removed, and W_i, the square sum before trends."""
    p, width = batch.p, batch.width
    fe = _model_in([i for i, s in enumerate(batch.specs) if s.entity])
    table = table.selectExpr(
        "*",
        *[f"CASE WHEN {fe} THEN s_{i} / n ELSE 0.0D END AS a_{i}" for i in range(p)],
        f"CASE WHEN {fe} THEN 1 ELSE 0 END AS rank",
    )
    net = "CASE WHEN {fe} THEN C_{i}_{j} ELSE S_{i}_{j} END" if batch.absorbed else "S_{i}_{j}"
    table = table.selectExpr("*", *[net.format(fe=fe, i=i, j=j) + f" AS A_{i}_{j}" for i, j in _pairs(p)])
    table = table.selectExpr("*", *[f"A_{i}_{i} AS W_{i}" for i in range(width)])
    for d in range(batch.degree):
        t = width + d
        usable = f"({fe} AND {_at('A', t, t)} > {ABSORB_TOL}D * {_at('S', t, t)})"
        inverse = f"CASE WHEN {usable} THEN 1.0D / {_at('A', t, t)} ELSE 0.0D END"
        table = table.selectExpr("*", f"{inverse} AS inv{d}", f"CASE WHEN {usable} THEN 1 ELSE 0 END AS used{d}")
        table = table.selectExpr("*", *[f"{_at('A', i, t)} * inv{d} AS b{d}_{i}" for i in range(p) if i != t])
        swept = {f"A_{i}_{j}" for i, j in _pairs(p) if t not in (i, j)}
        kept = [c for c in table.columns if c not in swept and c not in ("rank", f"used{d}")]
        table = table.selectExpr(
            *kept,
            f"rank + used{d} AS rank",
            *[f"A_{i}_{j} - b{d}_{i} * {_at('A', j, t)} AS A_{i}_{j}" for i, j in _pairs(p) if t not in (i, j)],
        )
    return table


def _totals(table: DataFrame, batch: _Batch) -> dict[int, dict]:
    width = batch.width
    base = ["n", *batch.group, *[f"a_{i}" for i in range(batch.p)]]
    base += [f"b{d}_{i}" for d in range(batch.degree) for i in range(batch.p) if i != width + d] + [f"inv{d}" for d in range(batch.degree)]
    aggs = [F.expr(e) for e in ("sum(n) AS n", "sum(rank) AS rank", "count(1) AS groups")]
    aggs += [F.expr(f"sum(s_{i}) AS s_{i}") for i in range(width)]
    aggs += [F.expr(f"sum(S_{i}_{i}) AS S_{i}_{i}") for i in range(width)]
    aggs += [F.expr(f"sum(W_{i}) AS W_{i}") for i in range(width)]
    aggs += [F.expr(f"sum(A_{i}_{j}) AS A_{i}_{j}") for i, j in _pairs(width)]
    if batch.group:
        first = F.struct(*batch.group)
        aggs.append(F.min_by(F.struct(*base), first).alias("base"))
    # One row per model; each has slots² numbers.
    return {r["model"]: r.asDict(recursive=True) for r in table.groupBy("model").agg(*aggs).collect()}


# -- driver algebra -----------------------------------------------------------


def independent(m: np.ndarray, ref: np.ndarray, tol: float = PIVOT_TOL) -> list[int]:
    """Indexes of a maximal independent set of columns of a Gram matrix, in order.

    A column is dropped when what is left of its square sum, after the columns before it, is
    below ``tol`` times the reference."""
    work = m.astype(float).copy()
    keep = []
    for j in range(len(work)):
        if work[j, j] > tol * max(ref[j], 1e-300):
            keep.append(j)
            col = work[:, j] / work[j, j]
            work = work - np.outer(col, work[j, :])
    return keep


def _inverse(m: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(m))
    return np.linalg.inv(m / np.outer(d, d)) / np.outer(d, d)


@dataclass
class _Solution:
    keep_x: list[int]
    keep_z: list[int]
    beta: np.ndarray
    bread: np.ndarray
    proj: np.ndarray
    rss: float
    gram: np.ndarray
    resid: np.ndarray


def _solve(plan: _Plan, tot: dict, width: int) -> _Solution:
    """Coefficients in scaled units. Index 0 is the constant, slot i is index i + 1."""
    size = len(plan.labels) + 1
    gram = np.zeros((size, size))
    ref = np.zeros(size)
    for i in range(1, size):
        for j in range(i, size):
            gram[i, j] = gram[j, i] = tot[f"A_{i - 1}_{j - 1}"]
        # within square sum; below the floor a column is constant in every group but for rounding
        ref[i] = max(tot[f"W_{i - 1}"], ROUNDING * tot[f"S_{i - 1}_{i - 1}"])
    spec = plan.spec
    own_const = spec.constant and not spec.entity
    if own_const:
        gram[0, 0] = ref[0] = tot["n"]
        for i in range(1, size):
            gram[0, i] = gram[i, 0] = tot[f"s_{i - 1}"]
    const = [0] if own_const else []
    exog = [i + 1 for i in plan.exog]
    endog = [i + 1 for i in plan.endog]
    xs = const + exog + endog
    zs = const + exog + [i + 1 for i in plan.instr] if spec.is_iv else xs
    keep_z = [zs[i] for i in independent(gram[np.ix_(zs, zs)], ref[zs])]
    if spec.is_iv:
        zx = gram[np.ix_(keep_z, xs)]
        first = _inverse(gram[np.ix_(keep_z, keep_z)]) @ zx
        xpx = zx.T @ first
        keep = independent(xpx, ref[xs])
        keep_x = [xs[i] for i in keep]
        proj = first[:, keep]
        bread = _inverse(xpx[np.ix_(keep, keep)])
        beta = bread @ (proj.T @ gram[keep_z, 1])
    else:
        keep_x = keep_z
        proj = np.eye(len(keep_x))
        bread = _inverse(gram[np.ix_(keep_x, keep_x)])
        beta = bread @ gram[keep_x, 1]
    resid = np.zeros(size)
    resid[1] = 1.0
    resid[keep_x] -= beta
    rss = float(resid @ gram @ resid)
    return _Solution(keep_x, keep_z, beta, bread, proj, max(rss, 0.0), gram, resid)


# -- score sums ---------------------------------------------------------------


def _resid_table(
    spark, solutions: dict[int, _Solution], p: int, leverage: bool, bases: dict[int, tuple] | None = None, key_types: str = ""
) -> DataFrame:
    rows = []
    for m, s in solutions.items():
        vec = [0.0] * (p + 1)
        for i, v in enumerate(s.resid):
            vec[i] = float(v)
        flat = []
        if leverage:
            full = np.zeros((p + 1, p + 1))
            full[np.ix_(s.keep_x, s.keep_x)] = s.bread
            flat = full.ravel().tolist()
        rows.append((m, vec, flat, *(bases[m] if bases else ())))
    # One row per model.
    return F.broadcast(spark.createDataFrame(rows, "model int, e array<double>, h array<double>" + key_types))


def _sum_terms(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _outer_sums(df: DataFrame, names: Sequence[str], weight: str = "", keys: Sequence[str] = ("model",)) -> dict:
    """Per model (or per key) the matrix of Σ weight·name_i·name_j."""
    w = f"{weight} * " if weight else ""
    aggs = [F.expr(f"sum({w}{names[i]} * {names[j]}) AS M_{i}_{j}") for i, j in _pairs(len(names))]
    out = {}
    for r in df.groupBy(*keys).agg(*aggs).collect():  # one row per model and test
        m = np.zeros((len(names), len(names)))
        for i, j in _pairs(len(names)):
            m[i, j] = m[j, i] = r[f"M_{i}_{j}"] or 0.0
        out[r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)] = m
    return out


def _cluster_meat(table: DataFrame, batch: _Batch, members: Sequence[int], coef: DataFrame, keys: Sequence[str] = ("model",)) -> dict:
    """Score sums per cluster are linear in the cluster's cross-products."""
    w = batch.width
    own = _model_in([m for m in members if not batch.specs[m].entity])
    const = " + ".join([f"e[0] * n", *[f"e[{l + 1}] * s_{l}" for l in range(w)]])
    scores = [f"CASE WHEN {own} THEN {const} ELSE 0.0D END AS u0"]
    for z in range(w):
        terms = [f"CASE WHEN {own} THEN e[0] * s_{z} ELSE 0.0D END"]
        terms += [f"e[{l + 1}] * {_at('A', z, l)}" for l in range(w)]
        scores.append(" + ".join(terms) + f" AS u{z + 1}")
    picked = table.filter(_model_in(list(members))).join(coef, ["model"])
    return _outer_sums(picked.selectExpr(*keys, *scores), [f"u{i}" for i in range(w + 1)], keys=keys)


def _vector_meats(stacked: DataFrame, table: DataFrame, batch: _Batch, vectors: dict[tuple[int, str], np.ndarray]) -> dict:
    """Sums of squared scores of any residuals of the models: each vector combines a model's (constant, slots) to one. Clusters that are the
    groups come from the group table, the others from one scan of the rows for all vectors."""
    w, keys = batch.width, ("model", "test")
    spark, out = stacked.sparkSession, {}

    def coefficients(part):
        rows = [(m, t, [float(v) for v in np.pad(e, (0, batch.p + 1 - len(e)))]) for (m, t), e in part.items()]
        return F.broadcast(spark.createDataFrame(rows, "model int, test string, e array<double>"))  # a row per model and test

    by_group = {k: e for k, e in vectors.items() if batch.specs[k[0]].vce == "cluster" and batch.specs[k[0]].cluster == batch.group}
    if by_group:
        out |= _cluster_meat(table, batch, sorted({m for m, _ in by_group}), coefficients(by_group), keys)
    rest: dict[tuple, dict] = {}
    for k, e in vectors.items():
        if k not in by_group:
            spec = batch.specs[k[0]]
            rest.setdefault(spec.cluster if spec.vce == "cluster" else (), {})[k] = e
    for cluster, part in rest.items():
        members = sorted({m for m, _ in part})
        own = [m for m in members if not batch.specs[m].entity]
        one = F.when(F.col("model").isin(*own), F.lit(1.0)).otherwise(F.lit(0.0)) if own else F.lit(0.0)
        names = ["z0"] + [f"v{i}" for i in range(w)]
        rows = _within_rows(stacked, table, batch).filter(F.col("model").isin(*members)).withColumn("z0", one).join(coefficients(part), ["model"])
        rows = rows.withColumn("err", F.expr(" + ".join(f"e[{i}] * {c}" for i, c in enumerate(names))))
        if cluster:
            scores = rows.groupBy(*keys, *cluster).agg(*[F.expr(f"sum(err * {c}) AS u{i}") for i, c in enumerate(names)])
            out |= _outer_sums(scores, [f"u{i}" for i in range(w + 1)], keys=keys)
        else:
            out |= _outer_sums(rows, names, "err * err", keys)
    return out


def _within_rows(stacked: DataFrame, table: DataFrame, batch: _Batch) -> DataFrame:
    """Rows with absorbed effects taken out of every slot."""
    if not any(s.entity for s in batch.specs):
        return stacked
    p, width = batch.p, batch.width
    extra = [f"a_{i}" for i in range(p)] + [f"b{d}_{i}" for d in range(batch.degree) for i in range(p) if i != width + d]
    joined = stacked.join(table.select("model", *batch.group, *extra), ["model", *batch.group])
    joined = joined.withColumns({f"v{i}": F.expr(f"v{i} - a_{i}") for i in range(p)})
    for d in range(batch.degree):
        t = width + d
        joined = joined.withColumns({f"v{i}": F.expr(f"v{i} - b{d}_{i} * v{t}") for i in range(p) if i != t})
    return joined.drop(*extra)


def _row_meat(
    rows: DataFrame, batch: _Batch, sols: dict[int, _Solution], totals: dict[int, dict], kind: str, cluster: Sequence[str] = ()
) -> dict[int, np.ndarray]:
    """Score sums from the rows. Position 0 is the constant, or with absorbed effects the base entity's rows with their weights in its
    intercept, which carry the sampling error of the reported constant."""
    w = batch.width
    own = [m for m in sols if not batch.specs[m].entity]
    one = F.when(F.col("model").isin(*own), F.lit(1.0)).otherwise(F.lit(0.0)) if own else F.lit(0.0)
    bases, types = None, ""
    if len(own) < len(sols):
        bases = {
            m: (1.0 / totals[m]["base"]["n"], *[float(w) for w in totals[m].get("weights", [0.0] * batch.degree)], *[totals[m]["base"][g] for g in batch.group])
            for m in sols
        }
        types = ", wb double" + "".join(f", w{d} double" for d in range(batch.degree)) + "".join(
            f", base_{g} {rows.schema[g].dataType.simpleString()}" for g in batch.group
        )
        in_base = F.lit(True)
        for g in batch.group:
            in_base = in_base & (F.col(g) == F.col(f"base_{g}"))
        is_own = F.col("model").isin(*own) if own else F.lit(False)
        weight = _sum_terms([F.col("wb"), *[F.col(f"w{d}") * F.col(f"v{w + d}") for d in range(batch.degree)]])
        one = F.when(is_own, F.lit(1.0)).when(in_base, weight).otherwise(F.lit(0.0))
    coef = _resid_table(rows.sparkSession, sols, batch.p, kind == "hc2", bases, types)
    df = rows.filter(F.col("model").isin(*sols)).join(coef, ["model"]).withColumn("z0", one)
    names = ["z0"] + [f"v{i}" for i in range(w)]
    df = df.withColumn("err", F.expr(" + ".join(f"e[{i}] * {c}" for i, c in enumerate(names))))
    if kind == "cluster":
        scores = df.groupBy("model", *cluster).agg(*[F.expr(f"sum(err * {c}) AS u{i}") for i, c in enumerate(names)])
        return _outer_sums(scores, [f"u{i}" for i in range(w + 1)])
    weight = "err * err"
    if kind == "hc2":
        p1 = batch.p + 1
        lev = " + ".join(f"h[{i * p1 + j}] * {a} * {b}" for i, a in enumerate(names) for j, b in enumerate(names))
        df = df.withColumn("lev", F.expr(lev))
        weight = "err * err / (1.0D - lev)"
    return _outer_sums(df, names, weight)


# -- assembly -----------------------------------------------------------------


def _trend_intercept(base: dict, batch: _Batch, scales: tuple[float, float], degree: int) -> np.ndarray:
    """Value at time zero of each slot's effect in the base group (scaled units)."""
    width = batch.width
    out = np.array([base[f"a_{i}"] for i in range(batch.p)], dtype=float)
    if degree == 0:
        return out[:width]
    u0 = (0.0 - scales[0]) / scales[1]
    # Trend slots at time zero, swept in the same order as the columns.
    point = np.zeros(batch.p)
    for d in range(degree):
        point[width + d] = u0 ** (d + 1)
    now = point - out
    value = out.copy()
    for d in range(degree):
        t = width + d
        for i in range(batch.p):
            if i != t:
                value[i] += base[f"b{d}_{i}"] * now[t]
                if i > t:
                    now[i] -= base[f"b{d}_{i}"] * now[t]
    return value[:width]


def _intercept_weights(base: dict, batch: _Batch, scales: tuple[float, float], degree: int) -> tuple[list[float], float]:
    """What each swept trend column of the base group adds to a row's weight in the group's intercept at time zero, and the sum of the
    squared weights."""
    width = batch.width
    u0 = (0.0 - scales[0]) / scales[1]
    now = np.array([-base[f"a_{i}"] for i in range(batch.p)], dtype=float)
    for d in range(degree):
        now[width + d] += u0 ** (d + 1)
    out, square = [], 1.0 / base["n"]
    for d in range(batch.degree):
        t = width + d
        out.append(now[t] * base[f"inv{d}"])
        square += now[t] * now[t] * base[f"inv{d}"]
        for i in range(t + 1, batch.p):
            now[i] -= base[f"b{d}_{i}"] * now[t]
    # Rows of a trend column are less the later columns as well (see ``_within_rows``).
    for d in range(batch.degree):
        for e in range(d + 1, batch.degree):
            out[e] += out[d] * base[f"b{e}_{width + d}"]
    return out, square


def _assemble(plan: _Plan, batch: _Batch, tot: dict, sol: _Solution, meat, clusters, scales) -> FitResult:
    spec = plan.spec
    n, absorbed = int(tot["n"]), int(tot["rank"])
    k = len(sol.keep_x) + absorbed + spec.extra_k
    sy = plan.scale[0]
    own_const = spec.constant and not spec.entity
    rss = sol.rss * sy * sy
    if spec.constant or spec.entity:
        tss = (tot["S_0_0"] - tot["s_0"] ** 2 / n) * sy * sy
    else:
        tss = tot["S_0_0"] * sy * sy
    df_resid = n - k
    sigma2 = sol.rss / df_resid if df_resid > 0 else math.nan
    # Estimates in scaled units: the coefficients and, with absorbed effects, the base effect,
    # which is the effect in y minus the effects in the regressors times their coefficients.
    m = len(sol.keep_x)
    based = spec.constant and bool(spec.entity)
    levels = np.zeros(len(plan.labels))
    degree = spec.trend[1] if spec.trend else 0
    if based:
        levels = _trend_intercept(tot["base"], batch, scales.get("trend", (0.0, 1.0)), degree)
    pull = -levels[[i - 1 for i in sol.keep_x]] if based else np.zeros(m)
    theta = np.append(sol.beta, levels[0] + pull @ sol.beta)
    sloped = np.vstack([np.eye(m), pull])
    if spec.vce == "classical":
        cov = sloped @ sol.bread @ sloped.T
        if based:
            cov[-1, -1] += tot["square"]
        cov = cov * (sigma2 if spec.dof == "full" else sol.rss / n)
    else:
        influence = sloped @ (sol.bread @ sol.proj.T)
        picks = list(sol.keep_z)
        # Clustered by the absorbed entity, the base effect's own residuals sum to zero.
        if based and not (spec.vce == "cluster" and spec.cluster == spec.entity):
            influence = np.column_stack([influence, np.append(np.zeros(m), 1.0)])
            picks.append(0)
        cov = influence @ meat[np.ix_(picks, picks)] @ influence.T
        if spec.vce == "hc1" and spec.dof == "full":
            cov = cov * (n / df_resid if df_resid > 0 else math.nan)
        if spec.vce == "cluster" and spec.dof != "none":
            g = clusters
            cov = cov * (g / (g - 1.0) if g > 1 else math.nan)
            if spec.dof == "full":
                cov = cov * ((n - 1.0) / df_resid if df_resid > 0 else math.nan)

    # Back to original units. The constant takes up the shifts.
    terms = [label_of(t) for t in spec.regressors]
    report_const = spec.constant
    size = len(terms) + (1 if report_const else 0)
    pos = {s + 1: i for i, s in enumerate(plan.endog + plan.exog)}
    trans = np.zeros((size, m + 1))
    base = np.zeros(size)
    for c, idx in enumerate(sol.keep_x):
        if idx == 0:
            trans[-1, c] += sy
        else:
            trans[pos[idx], c] = sy / plan.scale[idx - 1]
            if report_const:
                trans[-1, c] -= (sy / plan.scale[idx - 1]) * plan.shift[idx - 1]
    if report_const:
        base[-1] = plan.shift[0]
        trans[-1, -1] = sy if based else 0.0
        terms = terms + ["_cons"]
    beta = trans @ theta + base
    cov_out = trans @ cov @ trans.T
    dropped = [i for idx, i in pos.items() if idx not in sol.keep_x]
    if own_const and 0 not in sol.keep_x:
        dropped.append(size - 1)
    beta[dropped] = math.nan
    cov_out[dropped, :] = math.nan
    cov_out[:, dropped] = math.nan
    r2 = 1.0 - rss / tss if tss > 0 else math.nan
    has_const = 1 if (spec.constant or spec.entity) else 0
    adj = 1.0 - (1.0 - r2) * (n - has_const) / df_resid if df_resid > 0 else math.nan
    normal = spec.is_iv and spec.dof != "full"
    df = (clusters - 1) if spec.vce == "cluster" else df_resid
    rmse_df = n if normal else df_resid
    return FitResult(
        spec=spec,
        terms=terms,
        beta=beta,
        cov=cov_out,
        n=n,
        k=k,
        df=float(df),
        r2=r2,
        adj_r2=adj,
        rmse=math.sqrt(rss / rmse_df) if rmse_df > 0 else math.nan,
        rss=rss,
        n_clusters=int(clusters) if spec.vce == "cluster" else None,
        normal=normal,
        moments=sol.gram,
        moment_labels=["_cons", *plan.labels],
    )


def _group_of(spec: ModelSpec) -> tuple[str, ...]:
    if spec.entity:
        return spec.entity
    return spec.cluster if spec.vce == "cluster" else ()


def _effects(table: DataFrame, batch: _Batch, m: int, sol: _Solution, scales: tuple[float, float]) -> DataFrame:
    """Entity effects of one model in scaled units: value = e0 + e1·u + e2·u²…"""
    plan = batch.plans[m]
    w = len(plan.labels)
    rows = table.filter(F.col("model") == m)
    weights = {i - 1: float(v) for i, v in enumerate(sol.resid) if i > 0 and v != 0.0}

    def combine(prefix):
        return _sum_terms([F.lit(v) * F.col(f"{prefix}{i}") for i, v in weights.items()])

    degree = batch.degree
    t0 = batch.width
    if degree == 0:
        return rows.select(*batch.group, combine("a_").alias("__e0"))
    if degree == 1:
        return rows.select(
            *batch.group,
            (combine("a_") - combine("b0_") * F.col(f"a_{t0}")).alias("__e0"),
            combine("b0_").alias("__e1"),
        )
    g0, g1, q = combine("b0_"), combine("b1_"), F.col(f"b0_{t0 + 1}")
    ut, u2 = F.col(f"a_{t0}"), F.col(f"a_{t0 + 1}")
    return rows.select(
        *batch.group,
        (combine("a_") - g0 * ut - g1 * (u2 - q * ut)).alias("__e0"),
        (g0 - g1 * q).alias("__e1"),
        g1.alias("__e2"),
    )


def fit_all(
    df: DataFrame, specs: Sequence[ModelSpec], keep_effects: bool = False, cache: bool = True, scores: Vectors | None = None
) -> list[FitResult]:
    """Fit every model; results come back in the order of the specs.

    ``scores`` may name, for each fit, further residuals as combinations of its moment columns; their sums of squared scores
    (by the model's own clusters, if any) are put into the fit's ``scores``, for one more scan in all.

    The rows are scanned two or three times per batch, so their used columns are kept (memory,
    then disk) while the fits run; ``cache=False`` scans ``df`` again instead, which is better
    for a plain file scan.
    """
    columns = _distinct_columns(specs)
    names_by_key = {key: f"c{i}" for i, key in enumerate(columns)}
    # Keys get names of their own, so that no column name of the caller can clash.
    keys = {g: f"__g{i}" for i, g in enumerate(dict.fromkeys(g for s in specs for g in (*s.entity, *s.cluster)))}
    inner = [
        replace(s, entity=tuple(keys[g] for g in s.entity), cluster=tuple(keys[g] for g in s.cluster)) for s in specs
    ]
    rows = df.select(*[F.col(g).alias(k) for g, k in keys.items()], *[F.nanvl(columns[k], F.lit(None).cast("double")).alias(c) for k, c in names_by_key.items()])
    if cache:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        results = _fit_rows(rows, inner, names_by_key, keep_effects, scores)
    finally:
        if cache:
            rows.unpersist()
    for fit, spec in zip(results, specs):
        fit.spec = spec
        if fit.effects:
            table, *rest = fit.effects
            fit.effects = (table.withColumnsRenamed({k: g for g, k in keys.items()}), *rest)
    return results


def _fit_rows(
    rows: DataFrame, specs: Sequence[ModelSpec], names_by_key: dict, keep_effects: bool, scores: Vectors | None
) -> list[FitResult]:
    scales = _centre_and_scale(rows, list(names_by_key.values()))
    batches: dict[tuple, list[int]] = {}
    for i, s in enumerate(specs):
        batches.setdefault((_group_of(s), (*s.entity, *s.cluster)), []).append(i)
    results: list[FitResult | None] = [None] * len(specs)
    for (group, _), members in batches.items():
        batch = _Batch([specs[i] for i in members], group)
        stacked = _stack(rows, batch, names_by_key, scales)
        table = _absorb(_group_moments(stacked, group, batch.p, batch.absorbed), batch)
        reused = bool(group)
        if reused:
            table = table.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            totals = _totals(table, batch)
            sols = {}
            for m, plan in enumerate(batch.plans):
                if m not in totals:
                    raise ValueError(f"model {plan.spec.name}: no complete row")
                sols[m] = _solve(plan, totals[m], batch.width)
                if plan.spec.entity:
                    trend = plan.spec.trend
                    tscale = scales[names_by_key[_key(trend[0])]] if trend else (0.0, 1.0)
                    weights, square = _intercept_weights(totals[m]["base"], batch, tscale, trend[1] if trend else 0)
                    totals[m] |= {"weights": weights, "square": square}
            meats: dict[int, np.ndarray] = {}
            counts: dict[int, int] = {m: int(totals[m]["groups"]) for m in totals}
            by_group = {m: s for m, s in sols.items() if batch.specs[m].vce == "cluster" and batch.specs[m].cluster == group}
            if by_group:
                meats |= _cluster_meat(table, batch, list(by_group), _resid_table(table.sparkSession, by_group, batch.p, False))
            row_kinds: dict[tuple, dict[int, _Solution]] = {}
            for m, s in sols.items():
                spec = batch.specs[m]
                if m in by_group or spec.vce == "classical":
                    continue
                if spec.vce == "hc2" and (spec.entity or spec.is_iv):
                    raise NotImplementedError("hc2 is for least squares without absorbed effects")
                kind = spec.vce if spec.vce in ("cluster", "hc2") else "hc"
                row_kinds.setdefault((kind, spec.cluster if kind == "cluster" else ()), {})[m] = s
            if row_kinds:
                within = _within_rows(stacked, table, batch)
                for (kind, cluster), part in row_kinds.items():
                    meats |= _row_meat(within, batch, part, totals, kind, cluster)
                    if kind == "cluster":
                        got = (
                            within.filter(F.col("model").isin(*part))
                            .select("model", *cluster)
                            .distinct()
                            .groupBy("model")
                            .agg(F.count(F.lit(1)).alias("g"))
                        )
                        counts |= {r["model"]: int(r["g"]) for r in got.collect()}
            for m, i in enumerate(members):
                spec = batch.specs[m]
                tscale = scales[names_by_key[_key(spec.trend[0])]] if spec.trend else (0.0, 1.0)
                fit = _assemble(
                    batch.plans[m], batch, totals[m], sols[m], meats.get(m), counts[m], {"trend": tscale}
                )
                if keep_effects and spec.entity:
                    effects = _effects(table, batch, m, sols[m], tscale)
                    fit.effects = (materialize(effects, "effects"), batch.plans[m], tscale)
                results[i] = fit
            if scores:
                fits = {m: results[i] for m, i in enumerate(members)}
                vectors = {(m, name): e for m, f in fits.items() for name, e in scores(f).items()}
                for (m, name), meat in (_vector_meats(stacked, table, batch, vectors) if vectors else {}).items():
                    size = len(fits[m].moments)
                    fits[m].scores[name] = meat[:size, :size]
        finally:
            if reused:
                table.unpersist()
    return results
