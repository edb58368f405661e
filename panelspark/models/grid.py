"""Model grids: lists of specifications and their results as tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import interact
from ..operators.reshape import expand
from .engine import fit_all
from .linear import fit
from .spec import FitResult, ModelSpec, coefficients, models
from .wald import TestResult, test_equal


@dataclass
class GridResult:
    fits: list[FitResult]
    coefficients: DataFrame
    models: DataFrame

    def __getitem__(self, name: str) -> FitResult:
        return next(f for f in self.fits if f.spec.name == name)

    def with_fits(self, more: Sequence[FitResult]) -> GridResult:
        """The grid and further fits, in all three parts."""
        fits, spark = [*self.fits, *more], self.models.sparkSession
        return GridResult(fits, coefficients(spark, fits), models(spark, fits))


def run_grid(panel: DataFrame, specs: Sequence[ModelSpec]) -> GridResult:
    """Fit all specifications together (the number of Spark jobs does not grow with them)."""
    names = [s.name for s in specs]
    if len(set(names)) != len(names):
        raise ValueError("model names must be unique")
    fits = fit_all(panel, specs)
    spark = panel.sparkSession
    return GridResult(fits, coefficients(spark, fits), models(spark, fits))


def iv_design(
    name: str, y: str, endog: str, instruments: Sequence[str], exog: Sequence = (), **options
) -> list[ModelSpec]:
    """The four regressions of one design: first stage, reduced form, endogenous, 2SLS."""
    z = [instruments] if isinstance(instruments, str) else list(instruments)
    w = list(exog)
    plain = {k: v for k, v in options.items() if k != "dof"}
    return [
        ModelSpec(f"{name}:first_stage", endog, [*z, *w], **plain),
        ModelSpec(f"{name}:reduced_form", y, [*z, *w], **plain),
        ModelSpec(f"{name}:endogenous", y, [endog, *w], **plain),
        ModelSpec(f"{name}:iv", y, w, [endog], z, **options),
    ]


def first_stage_specs(
    measures: Sequence[str], instrument: str, controls: Sequence[str], entity: str, time: str
) -> list[ModelSpec]:
    """Per measure: plain, entity effects, with controls, with quadratic entity trends."""
    out = []
    opt = {"vce": "cluster", "cluster": entity}
    for m in measures:
        out += [
            ModelSpec(f"a_{m}", m, [instrument], **opt),
            ModelSpec(f"b_{m}", m, [instrument], entity=entity, **opt),
            ModelSpec(f"c_{m}", m, [instrument, *controls], entity=entity, **opt),
            ModelSpec(f"d_{m}", m, [instrument, *controls], entity=entity, trend=(time, 2), **opt),
        ]
    return out


def second_stage_specs(
    y: str,
    measures: Sequence[str],
    instrument: str,
    policies: Sequence[str],
    delays: Sequence[int],
    entity: str,
    time: str,
) -> list[ModelSpec]:
    """Per delay and measure: plain, entity effects, with controls, with linear entity trends.

    The measure's term gets the role ``mobility``, so that all measures share a table row.
    """
    out = []
    opt = {"vce": "cluster", "cluster": entity}
    for d in delays:
        z = f"{instrument}_m{d}"
        controls = [*[f"{p}_m{d}" for p in policies], f"{y}_m{d + 1}"]
        for m in measures:
            w = f"{m}_m{d}"
            roles = {w: f"mobility_m{d}"}
            out += [
                ModelSpec(f"a_{m}_m{d}", y, (), [w], [z], roles=roles, **opt),
                ModelSpec(f"b_{m}_m{d}", y, (), [w], [z], entity=entity, roles=roles, **opt),
                ModelSpec(f"c_{m}_m{d}", y, controls, [w], [z], entity=entity, roles=roles, **opt),
                ModelSpec(f"d_{m}_m{d}", y, controls, [w], [z], entity=entity, trend=(time, 1), roles=roles, **opt),
            ]
    return out


def two_lag_specs(
    y: str, measures: Sequence[str], instrument: str, policies: Sequence[str], lags: tuple[int, int], entity: str
) -> list[ModelSpec]:
    """Two lags of a measure instrumented by two lags of the instrument."""
    out = []
    near, far = lags
    z = [f"{instrument}_m{near}", f"{instrument}_m{far}"]
    controls = [f"{p}_m{far}" for p in policies]
    opt = {"vce": "cluster", "cluster": entity}
    for m in measures:
        w = [f"{m}_m{near}", f"{m}_m{far}"]
        roles = {w[0]: f"mobility_m{near}", w[1]: f"mobility_m{far}"}
        out += [
            ModelSpec(f"a_{m}_two", y, (), w, z, roles=roles, **opt),
            ModelSpec(f"b_{m}_two", y, (), w, z, entity=entity, roles=roles, **opt),
            ModelSpec(f"c_{m}_two", y, controls, w, z, entity=entity, roles=roles, **opt),
        ]
    return out


def attenuation_specs(
    y: str, measure: str, other: str, instrument: str, controls: Sequence[str], entity: str
) -> list[ModelSpec]:
    """Least squares, 2SLS by the instrument, 2SLS by a second measure of the same thing."""
    opt = {"vce": "cluster", "cluster": entity, "entity": entity}
    return [
        ModelSpec("ols", y, [measure, *controls], **opt),
        ModelSpec("iv_instrument", y, controls, [measure], [instrument], **opt),
        ModelSpec("iv_other_measure", y, controls, [measure], [other], **opt),
    ]


def daily_first_stage_specs(measures: Sequence[str], instrument: str, lagged: str, control: str, entity: str) -> list[ModelSpec]:
    out = []
    for m in measures:
        out += [
            ModelSpec(f"a_{m}", m, [instrument, lagged]),
            ModelSpec(f"b_{m}", m, [instrument, lagged], entity=entity),
            ModelSpec(f"c_{m}", m, [instrument, lagged, control], entity=entity),
        ]
    return out


def daily_second_stage_specs(
    y: str, measures: Sequence[str], instrument: str, control: str, entity: str, delay: int
) -> list[ModelSpec]:
    out = []
    z = f"{instrument}_m{delay}"
    for m in measures:
        w = f"{m}_m{delay}"
        roles = {w: f"mobility_m{delay}"}
        out += [
            ModelSpec(f"a_{w}", y, (), [w], [z], roles=roles),
            ModelSpec(f"b_{w}", y, (), [w], [z], entity=entity, roles=roles),
            ModelSpec(f"c_{w}", y, [control], [w], [z], entity=entity, roles=roles),
        ]
    return out


def equality_test(
    panel: DataFrame, y: str, measures: tuple[str, str], instrument: str, controls: Sequence[str], entity: str
) -> tuple[FitResult, TestResult]:
    """Do two measures have the same effect? Both equations are stacked with their own controls
    and entity effects, clustered by (equation, entity)."""
    first, second = measures
    stacked = expand(panel, 2, "number").withColumn(
        "both", F.when(F.col("number") == 2, F.col(second)).otherwise(F.col(first))
    )
    number = [1, 2]
    x = [t for c in controls for t in interact("number", number, c)]
    spec = ModelSpec(
        "stacked",
        y,
        x,
        interact("number", number, "both"),
        interact("number", number, instrument),
        entity=("number", entity),
        constant=False,
        vce="cluster",
        cluster=("number", entity),
    )
    result = fit(stacked, spec)
    return result, test_equal(result, "number=1:both", "number=2:both")


def f_statistics(grid: GridResult, term: str, digits: int = 3) -> DataFrame:
    """First-stage F of one term in every model, rounded."""
    from .wald import test_term

    rows = []
    for f in grid.fits:
        t = test_term(f, term)
        rows.append((f.spec.name, round(t.statistic, digits), t.df1, float(t.df2), t.p_value))
    return grid.coefficients.sparkSession.createDataFrame(
        rows, "model_id string, f double, df1 int, df2 double, p_value double"
    )
