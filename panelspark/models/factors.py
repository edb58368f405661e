"""Linear models in which columns have a coefficient of their own on each level of a factor, whatever the number of levels.

The cross-products of such a model are sparse: the columns of two levels have no row in common. They are kept as one row of small moments per level (or per
cluster of a level), with the levels read from the data. Each level's block is eliminated where its row lies; only the sum of what is left for the common
regressors, a matrix as large as their number, goes to the driver. The levels' coefficients and errors are put back into a table the same way and are
never collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import complete_cases
from ..session import materialize
from .engine import independent
from .spec import ModelSpec, FitResult, column_of, label_of

ONE = "_cons"


@dataclass
class LevelFit:
    """``common``: the regressors that all levels share. ``levels``: (factor, term, estimate, std_error, n) for each level and term; a term that a level's rows
    cannot tell from the ones before has no estimate."""

    common: FitResult
    levels: DataFrame


def _packed(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m))]


def _blocks(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The symmetric matrices of a batch, one per row, from their upper triangles."""
    flat = np.array([batch.column(f"s{i}").to_numpy(zero_copy_only=False) for i in range(size * (size + 1) // 2)]).T
    full = np.zeros((len(flat), size, size))
    rows, cols = np.triu_indices(size)
    full[:, rows, cols] = flat
    full[:, cols, rows] = flat
    return full


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverse over a maximal independent set of columns, zero elsewhere."""
    d = np.diag(a)
    scale = np.sqrt(np.where(d > 0, d, 1.0))
    unit = a / np.outer(scale, scale)
    keep = independent(unit, np.where(d > 0, 1.0, 0.0))
    out = np.zeros_like(a)
    if keep:
        out[np.ix_(keep, keep)] = np.linalg.inv(unit[np.ix_(keep, keep)])
    return out / np.outer(scale, scale)


def fit_levels(df: DataFrame, spec: ModelSpec, factor: str, columns: Sequence, intercept: bool = True) -> LevelFit:
    """Least squares of ``spec`` (y, x, name; vce classical, or cluster with clusters that lie within levels) and, on each level of
    ``factor``, coefficients of ``columns``, with an intercept of its own unless ``intercept`` is False.

    Rows with a null or NaN in a used column or key are left out. The jobs are three scans of small tables after one aggregate of the rows.
    """
    if spec.is_iv or spec.entity or spec.vce not in ("classical", "cluster"):
        raise ValueError("levels are for least squares with classical or clustered errors and no other effects")
    terms = ([ONE] if intercept else []) + [label_of(c) for c in columns]
    p, q = len(spec.x), len(terms)
    size = q + p + 1
    keys = ["__level", *[f"__q{i}" for i in range(len(spec.cluster))]]
    named = [F.col(factor).alias("__level"), *[F.col(c).alias(k) for c, k in zip(spec.cluster, keys[1:])]]
    slots = [*columns, *spec.x, spec.y]
    rows = complete_cases(df.select(*named, *[column_of(t).alias(f"__c{i}") for i, t in enumerate(slots)]), [*keys, *[f"__c{i}" for i in range(len(slots))]])
    rows = rows.where(" AND ".join(f"NOT isnan(__c{i})" for i in range(len(slots))))
    # Every column is brought to unit spread; columns that an intercept stands beside are centred too.
    facts = rows.agg(*[a for i in range(len(slots)) for a in (F.avg(f"__c{i}").alias(f"m{i}"), F.stddev_pop(f"__c{i}").alias(f"d{i}"))]).first()
    shift = np.array([facts[f"m{i}"] or 0.0 if intercept else 0.0 for i in range(len(slots))])
    scale = np.array([facts[f"d{i}"] or 1.0 for i in range(len(slots))])
    unit = [F.lit(1.0)] * intercept + [(F.col(f"__c{i}") - F.lit(float(shift[i]))) / F.lit(float(scale[i])) for i in range(len(slots))]
    unit = rows.select(*keys, *[c.alias(f"v{i}") for i, c in enumerate(unit)])
    pairs = list(zip(*np.triu_indices(size)))
    sums = [F.expr(f"sum(v{i} * v{j})").alias(f"s{k}") for k, (i, j) in enumerate(pairs)]
    clusters = unit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    by_cluster = spec.vce == "cluster"
    clusters = materialize(clusters, "level-clusters") if by_cluster else clusters
    again = [F.sum(f"s{k}").alias(f"s{k}") for k in range(len(pairs))]
    levels = clusters.groupBy("__level").agg(F.sum("n").alias("n"), *again) if by_cluster else clusters
    levels = materialize(levels, "levels")

    def eliminate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the levels leave for the common regressors and y, summed over a task."""
        left, n, used, count, y, yy = np.zeros((p + 1, p + 1)), 0, 0, 0, 0.0, 0.0
        for batch in batches:
            for m, k in zip(_blocks(batch, size), batch.column("n").to_pylist()):
                a = _inverse(m[:q, :q])
                left += m[q:, q:] - m[q:, :q] @ a @ m[:q, q:]
                n, used, count = n + k, used + int(np.count_nonzero(np.diag(a))), count + 1
                y, yy = y + m[0, -1] * intercept, yy + m[-1, -1]
        yield pa.RecordBatch.from_pydict({"left": [_packed(left).tolist()], "n": [n], "used": [used], "levels": [count], "y": [y], "yy": [yy]})

    size_left = (p + 1) * (p + 2) // 2
    got = levels.mapInArrow(eliminate, "left array<double>, n long, used long, levels long, y double, yy double")
    total = got.agg(*[F.sum(F.col("left")[i]).alias(f"l{i}") for i in range(size_left)], *[F.sum(c).alias(c) for c in ("n", "used", "levels", "y", "yy")]).first()
    if not total["n"]:
        raise ValueError(f"model {spec.name}: no complete row")
    left = np.zeros((p + 1, p + 1))
    left[np.triu_indices(p + 1)] = [total[f"l{i}"] for i in range(size_left)]
    left = left + np.triu(left, 1).T
    bread = _inverse(left[:p, :p])
    beta = bread @ left[:p, p]
    kept = int(np.count_nonzero(np.diag(bread)))
    rss = float(left[p, p] - beta @ left[:p, p])
    n, k = int(total["n"]), int(total["used"]) + kept
    free = n - k
    sigma2 = rss / free if free > 0 else math.nan
    resid = np.append(-beta, 1.0)

    level_kind = levels.schema["__level"].dataType.simpleString()
    if by_cluster:
        groups = clusters.count()
        small = groups / (groups - 1.0) * (n - 1.0) / free if groups > 1 and free > 0 else math.nan
        meat, sides = _scores(clusters, levels, spec, keys, p, q, resid)
        cov = small * bread @ meat @ bread
        levels = levels.join(sides, "__level")
    else:
        groups, cov = None, sigma2 * bread
    units, back = scale[: q - intercept], scale[-1]
    x_scale, x_shift, y_shift, v_shift = scale[q - intercept : -1], shift[q - intercept : -1], shift[-1], shift[: q - intercept]

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Coefficients and errors of each level in original units."""
        for batch in batches:
            out: dict[str, list] = {"level": [], "term": [], "estimate": [], "std_error": [], "n": []}
            extra = {c: batch.column(c).to_pylist() for c in ("zz", "zx")} if by_cluster else {}
            for i, (level, rows_, m) in enumerate(zip(batch.column("__level").to_pylist(), batch.column("n").to_pylist(), _blocks(batch, size))):
                a = _inverse(m[:q, :q])
                on_x = a @ m[:q, q:-1]
                gamma = a @ (m[:q, q:] @ resid)
                if by_cluster:
                    zz, zx = np.array(extra["zz"][i]).reshape(q, q), np.array(extra["zx"][i]).reshape(q, p)
                    cross = a @ zx @ bread @ on_x.T
                    v = small * (a @ zz @ a - cross - cross.T) + on_x @ cov @ on_x.T
                else:
                    v = sigma2 * (a + on_x @ bread @ on_x.T)
                # Original units: slopes by y's spread over the column's; the intercept takes up all shifts.
                turn = np.zeros((q, q))
                move = np.zeros((q, p))
                add = np.zeros(q)
                for j in range(q - intercept):
                    turn[j + intercept, j + intercept] = back / units[j]
                if intercept:
                    turn[0, 0] = back
                    turn[0, 1:] = -back * v_shift / units
                    move[0] = -back * x_shift / x_scale
                    add[0] = y_shift
                value = turn @ gamma + move @ beta + add
                # cov(gamma, beta): through the common regressors, and through the shared clusters
                both = -on_x @ cov
                if by_cluster:
                    both = both + small * a @ zx @ bread
                full = turn @ v @ turn.T + turn @ both @ move.T + (turn @ both @ move.T).T + move @ cov @ move.T
                known = np.diag(a) > 0
                for j, term in enumerate(terms):
                    out["level"].append(level), out["term"].append(term), out["n"].append(rows_)
                    out["estimate"].append(float(value[j]) if known[j] else None)
                    out["std_error"].append(math.sqrt(max(full[j, j], 0.0)) if known[j] and not math.isnan(full[j, j]) else None)
            arrays = [pa.array(out["level"], batch.schema.field("__level").type), pa.array(out["term"], pa.string())]
            arrays += [pa.array(out["estimate"], pa.float64()), pa.array(out["std_error"], pa.float64()), pa.array(out["n"], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=list(out))

    table = levels.mapInArrow(put_back, f"level {level_kind}, term string, estimate double, std_error double, n long")
    names = [label_of(t) for t in spec.x]
    turn = back / x_scale
    dead = np.diag(bread) == 0
    estimate, cov_out = beta * turn, cov * np.outer(turn, turn)
    estimate[dead] = math.nan
    cov_out[dead, :] = math.nan
    cov_out[:, dead] = math.nan
    tss = (total["yy"] - total["y"] ** 2 / n) * back**2 if intercept else total["yy"] * back**2
    r2 = 1.0 - rss * back**2 / tss if tss > 0 else math.nan
    adjusted = 1.0 - (1.0 - r2) * (n - int(intercept)) / free if free > 0 else math.nan
    common = FitResult(
        spec, names, estimate, cov_out, n, k, float(groups - 1 if by_cluster else free), r2, adjusted,
        back * math.sqrt(rss / free) if free > 0 else math.nan, rss * back**2, groups, False,
    )
    return LevelFit(common, table.withColumnRenamed("level", factor))


def _scores(clusters: DataFrame, levels: DataFrame, spec: ModelSpec, keys: list[str], p: int, q: int, resid: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """The common regressors' sum of squared cluster scores, and (level, zz, zx): each level's own and cross sums. Scores are linear in a cluster's
    cross-products, so no row is read again."""
    size = q + p + 1
    named = [f"s{i}" for i in range(size * (size + 1) // 2)]
    wide = clusters.join(levels.select("__level", F.array(*named).alias("all")), "__level")
    kind = wide.schema["__level"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = np.triu_indices(size)
            zu, xu, whole = [], [], np.zeros((size, size))
            for m, every in zip(_blocks(batch, size), batch.column("all").to_pylist()):
                whole[rows, cols] = every
                whole[cols, rows] = every
                a = _inverse(whole[:q, :q])
                gamma = a @ (whole[:q, q:] @ resid)
                z = m[:q, q:] @ resid - m[:q, :q] @ gamma
                x = m[q:-1, q:] @ resid - m[q:-1, :q] @ gamma
                zu.append(z)
                xu.append(x - (a @ whole[:q, q:-1]).T @ z)
            arrays = [batch.column("__level"), pa.array([z.tolist() for z in zu], pa.list_(pa.float64())), pa.array([x.tolist() for x in xu], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["__level", "zu", "xu"])

    scores = materialize(wide.mapInArrow(score, f"__level {kind}, zu array<double>, xu array<double>"), "scores")
    meat = np.zeros((p, p))
    if p:
        sums = [F.sum(F.col("xu")[i] * F.col("xu")[j]).alias(f"m{i}_{j}") for i in range(p) for j in range(p)]
        got = scores.agg(*sums).first()
        meat = np.array([[got[f"m{i}_{j}"] for j in range(p)] for i in range(p)], float)
    own = [F.sum(F.col("zu")[i] * F.col("zu")[j]) for i in range(q) for j in range(q)]
    cross = [F.sum(F.col("zu")[i] * F.col("xu")[j]) for i in range(q) for j in range(p)]
    empty = F.array().cast("array<double>")
    return meat, scores.groupBy("__level").agg(F.array(*own).alias("zz"), (F.array(*cross) if cross else F.first(empty)).alias("zx"))
