"""LASSO path and cross-validation from cross-products computed in Spark."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import complete_cases
from ..session import materialize

N_LAMBDA = 100
MIN_RATIO = 1e-4


def standardize(df: DataFrame, y: str, x: Sequence[str]) -> DataFrame:
    """Complete rows with y centred and every x centred and divided by its sample sd."""
    rows = materialize(complete_cases(df, [y, *x]), "lasso")
    stats = rows.agg(
        F.struct(
            F.avg(y).alias("my"),
            *[F.avg(c).alias(f"m_{c}") for c in x],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in x],
        ).alias("s")
    ).scalar()
    return rows.withColumns(
        {y: F.col(y) - stats["my"]} | {c: F.try_divide(F.col(c) - stats[f"m_{c}"], stats[f"s_{c}"]) for c in x}
    )


def hash_fold(keys: Sequence[str], folds: int) -> Column:
    """Reproducible fold of a row from its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(folds)).cast("int")


@dataclass
class Moments:
    """Count, means and sums of co-moments about the means of (y, x…). Means far from zero cost no digits of the spread."""

    n: float
    mean: np.ndarray
    c: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.c + other.c + np.outer(gap, gap) * (self.n * other.n / n))

    def __sub__(self, part: Moments) -> Moments:
        """The moments of the rows that are not in ``part``."""
        n = self.n - part.n
        mean = self.mean + (self.mean - part.mean) * (part.n / n)
        gap = part.mean - mean
        return Moments(n, mean, self.c - part.c - np.outer(gap, gap) * (n * part.n / self.n))

    @property
    def raw(self) -> np.ndarray:
        """Means of products about zero."""
        return self.c / self.n + np.outer(self.mean, self.mean)

    @property
    def sd(self) -> np.ndarray:
        """Population sds of the x; 1 for a constant."""
        sd = np.sqrt(np.maximum(np.diag(self.c)[1:] / self.n, 0.0))
        return np.where(sd == 0.0, 1.0, sd)


def moments_by(df: DataFrame, cols: Sequence[str], by: Column | None = None) -> dict[int, Moments]:
    """Moments of the columns per fold: one aggregate, folds × k² numbers to the driver."""
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    at = [F.col(c).cast("double") for c in cols]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(at)]]
    aggs += [F.covar_pop(at[i], at[j]).alias(f"C_{i}_{j}") for i, j in pairs]
    fold = by if by is not None else F.lit(0)
    out = {}
    for r in df.groupBy(fold.alias("fold")).agg(*aggs).collect():
        c = np.zeros((k, k))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"C_{i}_{j}"] * r["n"]
        out[r["fold"]] = Moments(float(r["n"]), np.array([r[f"m_{i}"] for i in range(k)], float), c)
    return out


SWEEPS = 1_000_000  # a fit that needs more fails


def _soft(value: float, by: float) -> float:
    return np.sign(value) * max(abs(value) - by, 0.0)


def _descend(gram: Moments, lambdas: Sequence[float], tol: float = 1e-12) -> np.ndarray:
    """Coefficients for each lambda on (1/2n)|y − Xb|² + lambda·|b| without intercept.

    ``gram`` is over (y, x…). Inside, each x is divided by its population sd.
    """
    sd, raw = gram.sd, gram.raw
    a = raw[1:, 1:] / np.outer(sd, sd)
    c = raw[1:, 0] / sd
    b = np.zeros(len(c))
    out = np.zeros((len(lambdas), len(c)))
    for row, lam in enumerate(lambdas):
        for _ in range(SWEEPS):
            biggest = 0.0
            for j in range(len(c)):
                if a[j, j] <= 0.0:
                    continue
                new = _soft(c[j] - a[j] @ b + a[j, j] * b[j], lam) / a[j, j]
                biggest = max(biggest, abs(new - b[j]))
                b[j] = new
            if biggest < tol * (1.0 + np.abs(b).max()):
                break
        else:
            raise ArithmeticError(f"no convergence in {SWEEPS} sweeps at lambda {lam}")
        out[row] = b / sd
    return out


def _lambda_path(gram: Moments, n_lambda: int, min_ratio: float) -> np.ndarray:
    top = np.abs(gram.raw[1:, 0] / gram.sd).max()
    return top * np.exp(np.linspace(0.0, np.log(min_ratio), n_lambda))


@dataclass
class LassoPath:
    x: list[str]
    lambdas: np.ndarray
    beta: np.ndarray
    gram: Moments

    def gap(self) -> np.ndarray:
        """How far each step is from its optimality conditions, as a share of lambda: the slope of the error is lambda against the sign of a term in
        use, and no steeper than lambda at others."""
        raw, sd = self.gram.raw, self.gram.sd
        slope = (raw[1:, 0] - self.beta @ raw[1:, 1:]) / sd
        used = self.beta != 0.0
        off = np.where(used, np.abs(slope - np.sign(self.beta) * self.lambdas[:, None]), np.maximum(np.abs(slope) - self.lambdas[:, None], 0.0))
        return off.max(axis=1) / self.lambdas

    def table(self, spark: SparkSession) -> DataFrame:
        """Long form (step, lambda, term, estimate), for a coefficient-path plot."""
        rows = [
            (i + 1, float(lam), t, float(self.beta[i, j]))
            for i, lam in enumerate(self.lambdas)
            for j, t in enumerate(self.x)
        ]
        return spark.createDataFrame(rows, "step int, lambda double, term string, estimate double")


@dataclass
class LassoCV:
    path: LassoPath
    cvm: np.ndarray
    cvsd: np.ndarray
    lambda_min: float
    lambda_1se: float
    beta_min: np.ndarray
    beta_1se: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i + 1, float(lam), float(self.cvm[i]), float(self.cvsd[i]), int((self.path.beta[i] != 0).sum()))
            for i, lam in enumerate(self.path.lambdas)
        ]
        return spark.createDataFrame(rows, "step int, lambda double, cv_error double, cv_sd double, n_nonzero int")

    def selected(self, spark: SparkSession) -> DataFrame:
        rows = [
            (t, float(self.lambda_1se), float(b), int(b != 0.0), float(self.lambda_min), float(m))
            for t, b, m in zip(self.path.x, self.beta_1se, self.beta_min)
        ]
        return spark.createDataFrame(
            rows, "term string, lambda_1se double, estimate double, selected int, lambda_min double, estimate_min double"
        )


def lasso_path(
    df: DataFrame, y: str, x: Sequence[str], n_lambda: int = N_LAMBDA, min_ratio: float = MIN_RATIO, lambdas=None
) -> LassoPath:
    """Path without intercept on the data as given (standardise first, see ``standardize``)."""
    gram = moments_by(complete_cases(df, [y, *x]), [y, *x])[0]
    path = _lambda_path(gram, n_lambda, min_ratio) if lambdas is None else np.asarray(lambdas, dtype=float)
    return LassoPath(list(x), path, _descend(gram, path), gram)


def cv_lasso(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    keys: Sequence[str],
    folds: int = 10,
    n_lambda: int = N_LAMBDA,
    min_ratio: float = MIN_RATIO,
    fold: Column | None = None,
) -> LassoCV:
    """K-fold cross-validation with the one-standard-error rule and a refit on all rows. Rows are dealt by a hash of their keys, or by the
    column ``fold``.

    One aggregate by fold serves all fits: the training cross-products are the total minus the
    fold, and the held-out error follows from the fold's own cross-products.
    """
    grams = moments_by(complete_cases(df, [y, *x]), [y, *x], hash_fold(keys, folds) if fold is None else fold)
    total = functools.reduce(operator.add, grams.values())
    lambdas = _lambda_path(total, n_lambda, min_ratio)
    path = LassoPath(list(x), lambdas, _descend(total, lambdas), total)
    errors, weights = [], []
    for _, g in sorted(grams.items()):
        b = _descend(total - g, lambdas)
        raw = g.raw
        errors.append(raw[0, 0] - 2.0 * b @ raw[1:, 0] + np.einsum("ij,jk,ik->i", b, raw[1:, 1:], b))
        weights.append(g.n)
    e = np.array(errors)
    w = np.array(weights)
    cvm = np.average(e, axis=0, weights=w)
    cvsd = np.sqrt(np.average((e - cvm) ** 2, axis=0, weights=w) / (len(w) - 1))
    best = int(np.argmin(cvm))
    one = int(np.argmax(cvm <= cvm[best] + cvsd[best]))
    return LassoCV(path, cvm, cvsd, lambdas[best], lambdas[one], path.beta[best], path.beta[one])
