"""Tests on estimated coefficients and instrument diagnostics (driver algebra on small matrices)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.stats_dist import chi2_upper, f_upper
from .engine import fit_all, independent
from .spec import FitResult, ModelSpec


@dataclass(frozen=True)
class TestResult:
    """F form for least squares (df2 set), chi-square form for two-stage least squares."""

    name: str
    statistic: float
    df1: int
    df2: float | None
    p_value: float

    def row(self) -> tuple:
        def clean(v):
            return None if v is None or math.isnan(v) else float(v)

        return (self.name, clean(self.statistic), self.df1, clean(self.df2), clean(self.p_value))


TESTS = "test string, statistic double, df1 int, df2 double, p_value double"


def tests_table(spark: SparkSession, tests: Sequence[TestResult]) -> DataFrame:
    return spark.createDataFrame([t.row() for t in tests], TESTS)


def wald(fit: FitResult, restrictions: Sequence[dict[str, float]], values: Sequence[float] | None = None, name: str = "") -> TestResult:
    """Test R·beta = r. Each restriction maps terms to weights. Redundant ones are left out."""
    r = np.zeros((len(restrictions), len(fit.terms)))
    for i, weights in enumerate(restrictions):
        for term, w in weights.items():
            r[i, fit.index(term)] = w
    target = np.zeros(len(restrictions)) if values is None else np.asarray(values, dtype=float)
    used = np.any(r != 0.0, axis=0)
    gap = r[:, used] @ fit.beta[used] - target
    v = r[:, used] @ fit.cov[np.ix_(used, used)] @ r[:, used].T
    if np.isnan(v).any() or np.isnan(gap).any():
        return TestResult(name, math.nan, len(restrictions), None, math.nan)
    keep = independent(v, np.diag(v), 1e-10)
    q = len(keep)
    chi2 = float(gap[keep] @ np.linalg.solve(v[np.ix_(keep, keep)], gap[keep]))
    if fit.normal:
        return TestResult(name, chi2, q, None, chi2_upper(chi2, q))
    return TestResult(name, chi2 / q, q, fit.df, f_upper(chi2 / q, q, fit.df))


def test_term(fit: FitResult, term: str) -> TestResult:
    return wald(fit, [{term: 1.0}], name=term)


def test_joint(fit: FitResult, terms: Sequence[str]) -> TestResult:
    return wald(fit, [{t: 1.0} for t in terms], name=" ".join(terms))


def test_equal(fit: FitResult, a: str, b: str) -> TestResult:
    if a == b:
        raise ValueError("name two different terms")
    return wald(fit, [{a: 1.0, b: -1.0}], name=f"{a} = {b}")


# The name starts with "test"; keep test collectors away from it.
test_term.__test__ = test_joint.__test__ = test_equal.__test__ = False
TestResult.__test__ = False


def _rss(gram: np.ndarray, y: np.ndarray, xs: np.ndarray) -> tuple[float, int]:
    """Residual square sum and rank of the regression of one combination on others; ``xs`` holds
    combinations of the moment columns as columns."""
    g = xs.T @ gram @ xs
    keep = independent(g, np.diag(g))
    g = g[np.ix_(keep, keep)]
    c = xs[:, keep].T @ gram @ y
    return float(y @ gram @ y - c @ np.linalg.solve(g, c)), len(keep)


@dataclass(frozen=True)
class _IV:
    """A two-stage fit's moments and its parts, as combinations (columns) of the moment columns."""

    gram: np.ndarray
    y: np.ndarray
    endog: np.ndarray
    exog: np.ndarray
    instr: np.ndarray
    absorbed: int
    n: int

    @classmethod
    def of(cls, fit: FitResult) -> _IV:
        if not fit.spec.is_iv:
            raise ValueError("diagnostics are for two-stage least squares")
        gram = fit.moments
        eye = np.eye(len(gram))
        n_e, n_x = len(fit.spec.endog), len(fit.spec.x)
        exog = eye[:, 2 + n_e : 2 + n_e + n_x]
        constant = gram[0, 0] > 0
        if constant:
            exog = np.column_stack([eye[:, :1], exog])
        absorbed = fit.k - len([t for t in fit.terms if t != "_cons" and not math.isnan(fit.coef(t))]) - (1 if constant else 0)
        return cls(gram, eye[:, 1], eye[:, 2 : 2 + n_e], exog, eye[:, 2 + n_e + n_x :], absorbed, fit.n)

    @property
    def z(self) -> np.ndarray:
        return np.column_stack([self.exog, self.instr])

    @property
    def x(self) -> np.ndarray:
        return np.column_stack([self.exog, self.endog])

    def regress(self, target: np.ndarray, xs: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Independent columns of ``xs``, their coefficients, and the residual as a combination."""
        g = xs.T @ self.gram @ xs
        keep = independent(g, np.diag(g))
        beta = np.linalg.solve(g[np.ix_(keep, keep)], xs[:, keep].T @ self.gram @ target)
        return keep, beta, target - xs[:, keep] @ beta

    def first_stages(self) -> np.ndarray:
        """First-stage residuals of the endogenous regressors."""
        return np.column_stack([self.regress(w, self.z)[2] for w in self.endog.T])

    def second_stage(self) -> np.ndarray:
        """The two-stage residual, without the regressors that the instruments do not identify: the fit drops these too."""
        xh = np.column_stack([self.exog, self.endog - self.first_stages()])
        g = xh.T @ self.gram @ xh
        keep = independent(g, np.diag(self.x.T @ self.gram @ self.x))
        return self.y - self.x[:, keep] @ np.linalg.solve(g[np.ix_(keep, keep)], xh[:, keep].T @ self.gram @ self.y)

    def augmented(self) -> np.ndarray:
        """Regressors of the endogeneity test: those of the model and the first-stage residuals."""
        return np.column_stack([self.x, self.first_stages()])


def _iv_residuals(fit: FitResult) -> dict[str, np.ndarray]:
    """The residuals whose squared scores the robust diagnostics need."""
    iv = _IV.of(fit)
    out = {f"first:{i}": e for i, e in enumerate(iv.first_stages().T)}
    out["augmented"] = iv.regress(iv.y, iv.augmented())[2]
    out["second"] = iv.second_stage()
    return out


def _form(gap: np.ndarray, v: np.ndarray) -> tuple[float, int]:
    """Quadratic form of ``gap`` in the inverse of ``v``, and how many entries it is taken of: those that are redundant but for rounding are left out."""
    keep = independent(v, np.diag(v), 1e-14)
    return float(gap[keep] @ np.linalg.solve(v[np.ix_(keep, keep)], gap[keep])), len(keep)


def _robust_f(fit: FitResult, iv: _IV, target: np.ndarray, xs: np.ndarray, last: int, meat: np.ndarray, name: str) -> TestResult:
    """F form of the robust Wald test that the last ``last`` columns of a regression have no effect."""
    keep, beta, _ = iv.regress(target, xs)
    some = xs[:, keep]
    bread = np.linalg.inv(some.T @ iv.gram @ some)
    v = bread @ (some.T @ meat @ some) @ bread
    df2 = float(iv.n - len(keep) - iv.absorbed)
    tested = [i for i, k in enumerate(keep) if k >= xs.shape[1] - last]
    g = fit.n_clusters
    if not tested or df2 <= 0 or (fit.spec.vce == "cluster" and g < 2):
        return TestResult(name, math.nan, len(tested), g - 1.0 if fit.spec.vce == "cluster" else df2, math.nan)
    if fit.spec.vce == "cluster":
        v, df2 = v * (g / (g - 1.0)) * ((iv.n - 1.0) / df2), g - 1.0
    elif fit.spec.vce != "hc0":
        v = v * (iv.n / df2)
    form, q = _form(beta[tested], v[np.ix_(tested, tested)])
    f = form / q if q else math.nan
    return TestResult(name, f, q, df2, f_upper(f, q, df2) if q else math.nan)


def robust_iv_diagnostics(df: DataFrame, spec: ModelSpec) -> tuple[FitResult, list[TestResult]]:
    """The fit and its diagnostics in forms that hold under the model's own errors (heteroskedasticity or clusters), for one scan more than
    the fit: weak instruments and endogeneity as Wald F tests of the first stages and of the regression augmented by their residuals, and the score
    test of the over-identifying restrictions: the instruments that the second stage does not need, net of its regressors, must
    not move with its residual."""
    if spec.vce not in ("hc0", "hc1", "cluster"):
        raise ValueError("robust diagnostics are for hc0, hc1 and clustered errors")
    fit = fit_all(df, [spec], scores=_iv_residuals)[0]
    iv = _IV.of(fit)
    out = [
        _robust_f(fit, iv, w, iv.z, iv.instr.shape[1], fit.scores[f"first:{i}"], f"weak_instruments:{fit.moment_labels[2 + i]}")
        for i, w in enumerate(iv.endog.T)
    ]
    out.append(_robust_f(fit, iv, iv.y, iv.augmented(), iv.endog.shape[1], fit.scores["augmented"], "endogeneity"))
    hats = np.column_stack([iv.exog, iv.endog - iv.first_stages()])
    spare = np.column_stack([iv.regress(z, hats)[2] for z in iv.instr.T])
    left = spare.T @ iv.gram @ spare
    keep = independent(left, np.diag(iv.instr.T @ iv.gram @ iv.instr))
    if keep:
        r = spare[:, keep]
        s = r.T @ iv.gram @ iv.second_stage()
        score, q = _form(s, r.T @ fit.scores["second"] @ r)
        out.append(TestResult("overidentification_score", score if q else math.nan, q, None, chi2_upper(score, q) if q else math.nan))
    return fit, out


def iv_diagnostics(fit: FitResult) -> list[TestResult]:
    """Weak instruments (first-stage F per endogenous regressor), endogeneity (Wu–Hausman) and
    over-identification (Sargan), in their classical forms, from the moments of the fit."""
    iv = _IV.of(fit)
    gram, y, endog, exog, z, n = iv.gram, iv.y, iv.endog, iv.exog, iv.z, iv.n
    out = []
    for i in range(endog.shape[1]):
        w = endog[:, i]
        small, k_small = _rss(gram, w, exog) if exog.shape[1] else (float(w @ gram @ w), 0)
        full, k_full = _rss(gram, w, z)
        q, df2 = k_full - k_small, n - k_full - iv.absorbed
        f = ((small - full) / q) / (full / df2)
        out.append(TestResult(f"weak_instruments:{fit.moment_labels[2 + i]}", f, q, float(df2), f_upper(f, q, df2)))
    rss_ols, k_ols = _rss(gram, y, iv.x)
    rss_aug, k_aug = _rss(gram, y, iv.augmented())
    q, df2 = k_aug - k_ols, n - k_aug - iv.absorbed
    if q > 0:
        f = ((rss_ols - rss_aug) / q) / (rss_aug / df2)
        out.append(TestResult("wu_hausman", f, q, float(df2), f_upper(f, q, df2)))
    over = iv.instr.shape[1] - endog.shape[1]
    if over > 0:
        u = iv.second_stage()
        out_rss, _ = _rss(gram, u, z)
        s = n * (1.0 - out_rss / float(u @ gram @ u))
        out.append(TestResult("sargan", s, over, None, chi2_upper(s, over)))
    return out
