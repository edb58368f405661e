"""Model specifications and fit results."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats_dist import normal_two_sided, t_two_sided

Term = str | tuple[str, Column | str]  # a column, or a label and an expression (a Column or its SQL text)

VCES = ("classical", "hc0", "hc1", "hc2", "cluster")
DOFS = ("none", "cluster", "full")


def label_of(term: Term) -> str:
    return term if isinstance(term, str) else term[0]


def column_of(term: Term) -> Column:
    if isinstance(term, str):
        return F.col(term).cast("double")
    return (F.expr(term[1]) if isinstance(term[1], str) else term[1]).cast("double")


def _as_tuple(value) -> tuple:
    if value is None:
        return ()
    if isinstance(value, str):
        return (value,)
    return tuple(value)


@dataclass(frozen=True)
class ModelSpec:
    """One linear model.

    ``endog`` and ``instruments`` make it two-stage least squares. ``entity`` absorbs a fixed
    effect (one or more key columns), ``trend=(time, degree)`` adds entity-specific trends.
    ``dof`` is the small-sample rule: 'none', 'cluster' (G/(G-1) only) or 'full'. Least squares
    always uses 'full'; two-stage least squares defaults to 'none', with clusters to 'cluster'.
    ``roles`` renames terms in tables, so that different regressors can share a row.
    """

    name: str
    y: Term
    x: Sequence[Term] = ()
    endog: Sequence[Term] = ()
    instruments: Sequence[Term] = ()
    entity: str | Sequence[str] | None = None
    trend: tuple[str, int] | None = None
    constant: bool = True
    vce: str = "hc1"
    cluster: str | Sequence[str] | None = None
    dof: str | None = None
    roles: dict[str, str] = field(default_factory=dict)
    extra_k: int = 0

    def __post_init__(self):
        for name in ("x", "endog", "instruments"):
            value = getattr(self, name)
            if isinstance(value, str):
                value = (value,)
            object.__setattr__(self, name, tuple(value))
        for name in ("entity", "cluster"):
            object.__setattr__(self, name, _as_tuple(getattr(self, name)))
        if self.vce not in VCES:
            raise ValueError(f"vce must be one of {VCES}")
        if self.vce == "cluster" and not self.cluster:
            raise ValueError("a cluster column is needed")
        if len(self.instruments) < len(self.endog):
            raise ValueError(f"{self.name}: fewer instruments than endogenous regressors")
        if self.dof is None:
            rule = "full" if not self.endog else ("cluster" if self.vce == "cluster" else "none")
            object.__setattr__(self, "dof", rule)
        if self.trend and not self.entity:
            raise ValueError("trends are entity-specific: name the entity")

    @property
    def is_iv(self) -> bool:
        return bool(self.endog)

    @property
    def regressors(self) -> tuple[Term, ...]:
        """Endogenous first, then exogenous."""
        return (*self.endog, *self.x)

    @property
    def columns(self) -> tuple[Term, ...]:
        return (self.y, *self.endog, *self.x, *self.instruments)

    def named(self, name: str, **changes) -> ModelSpec:
        return replace(self, name=name, **changes)


def _clean(value) -> float | None:
    value = float(value)
    return None if math.isnan(value) or math.isinf(value) else value


@dataclass
class FitResult:
    """Estimates of one model in original units. Dropped (collinear) terms are NaN."""

    spec: ModelSpec
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    k: int
    df: float
    r2: float
    adj_r2: float
    rmse: float
    rss: float
    n_clusters: int | None
    normal: bool
    # Scaled cross-products over (constant, y, endog, exog, instruments), kept for tests.
    moments: np.ndarray = None
    moment_labels: list[str] = None
    effects: DataFrame | None = None
    # Sums of squared scores of further residuals, by name (see ``fit_all``).
    scores: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.sqrt(np.diag(self.cov))

    def index(self, term: str) -> int:
        return self.terms.index(term)

    def coef(self, term: str) -> float:
        return float(self.beta[self.index(term)])

    def std_error(self, term: str) -> float:
        return float(self.se[self.index(term)])

    def statistic(self, term: str) -> float:
        se = self.std_error(term)
        return self.coef(term) / se if se > 0 else math.nan

    def p_value(self, term: str) -> float:
        s = self.statistic(term)
        if math.isnan(s):
            return math.nan
        return normal_two_sided(s) if self.normal else t_two_sided(s, self.df)

    def coefficient_rows(self) -> list[tuple]:
        """(model_id, term, role, term_order, estimate, std_error, statistic, p_value)"""
        return [
            (
                self.spec.name,
                t,
                self.spec.roles.get(t, t),
                i,
                _clean(self.coef(t)),
                _clean(self.std_error(t)),
                _clean(self.statistic(t)),
                _clean(self.p_value(t)),
            )
            for i, t in enumerate(self.terms)
        ]

    def model_row(self) -> tuple:
        """(model_id, estimator, vce, n, k, df, r2, adj_r2, rmse, n_clusters)"""
        return (
            self.spec.name,
            "2sls" if self.spec.is_iv else "ols",
            self.spec.vce,
            int(self.n),
            int(self.k),
            _clean(self.df),
            _clean(self.r2),
            _clean(self.adj_r2),
            _clean(self.rmse),
            self.n_clusters,
        )


COEFFICIENTS = (
    "model_id string, term string, role string, term_order int, estimate double, std_error double, "
    "statistic double, p_value double"
)
MODELS = (
    "model_id string, estimator string, vce string, n long, k int, df double, r2 double, adj_r2 double, "
    "rmse double, n_clusters long"
)


def coefficients(spark: SparkSession, fits: Sequence[FitResult]) -> DataFrame:
    """Coefficient table of the models: a few rows per model."""
    return spark.createDataFrame([row for f in fits for row in f.coefficient_rows()], COEFFICIENTS)


def models(spark: SparkSession, fits: Sequence[FitResult]) -> DataFrame:
    return spark.createDataFrame([f.model_row() for f in fits], MODELS)
