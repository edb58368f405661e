"""Model suites: the specifications of each study part over its panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from ..models import grid as G
from ..models.lasso import LassoCV, LassoPath, cv_lasso, lasso_path, standardize
from ..models.linear import fit_two_way, fitted, residualize
from ..models.spec import ModelSpec
from ..models.tables import coef_table
from ..models.wald import TestResult, robust_iv_diagnostics, test_joint
from ..operators.clean import complete_cases, keep_not_in, poly
from ..operators.panel import (
    Panel,
    difference,
    lag_by,
    lagged_differences,
    log_difference,
    panel_features,
    shift_share_levels,
)
from ..session import materialize
from .panels import POLICIES, per_capita

MEASURES = ("d_dl_mobility", "d_una_distance", "d_twitter_sd")
WEEKLY_VARS = (
    "COVID_mortality",
    "COVID_mortality_pc",
    "COVID_infections",
    "COVID_infections_pc",
    "avg_precip",
    "una_pct_distance",
    "una_log_distance",
    "una_distance",
    "dl_mobility",
    "twitter_sd",
    *POLICIES,
)
# Entities left out of the lag selection (fixed values).
NOT_STATES = ("Puerto Rico", "American Samoa", "Diamond Princess", "Grand Princess", "Virgin Islands")


def weekly_features(panel: DataFrame, lags: int = 5, variables: Sequence[str] = WEEKLY_VARS) -> DataFrame:
    """Per-capita counts, then difference, log difference and lags of every variable. Written
    once: the model grids scan it repeatedly."""
    df = panel.withColumnRenamed("twitter_social_distancing", "twitter_sd")
    df = per_capita(df, {"COVID_mortality": "COVID_mortality_pc", "COVID_infections": "COVID_infections_pc"})
    return materialize(panel_features(Panel(df, "state", "date"), variables, lags), "weekly-features")


@dataclass
class WeeklySuite:
    first_stage: G.GridResult
    second_stage: G.GridResult
    two_lag: G.GridResult
    attenuation: G.GridResult
    equality: TestResult

    def tables(self) -> dict[str, DataFrame]:
        """One table per group of models: first stage, one per delay, two lags, comparison."""
        parts = {"first_stage": self.first_stage, "second_stage": self.second_stage, "two_lag": self.two_lag, "attenuation": self.attenuation}
        shapes = weekly_tables({k: [f.spec for f in g.fits] for k, g in parts.items()})
        return {
            name: coef_table(grid.coefficients, grid.models, order, ids, style=style)
            for name, (order, style, ids) in shapes.items()
            for grid in [parts["second_stage" if name.startswith("second_stage") else name]]
        }


def weekly_tables(parts: Mapping[str, Sequence[ModelSpec]]) -> dict[str, tuple[list[str], str, list[str]]]:
    """(roles in order, number style, models) of the tables of the weekly suite."""
    ids = {k: [s.name for s in specs] for k, specs in parts.items()}
    out = {"first_stage": (["d_avg_precip", "EmergDec", "GathRestrictAny", "d_COVID_mortality_pc_m1", "_cons"], "f", ids["first_stage"])}
    for d in sorted({int(name.rpartition("_m")[2]) for name in ids["second_stage"]}):
        order = [f"mobility_m{d}", f"EmergDec_m{d}", f"GathRestrictAny_m{d}", f"d_COVID_mortality_pc_m{d + 1}", "_cons"]
        out[f"second_stage_m{d}"] = (order, "e", [name for name in ids["second_stage"] if name.endswith(f"_m{d}")])
    out["two_lag"] = (["mobility_m1", "mobility_m3", "EmergDec_m3", "GathRestrictAny_m3", "_cons"], "e", ids["two_lag"])
    out["attenuation"] = (["d_una_distance_m3", *weekly_controls(), "_cons"], "e", ids["attenuation"])
    return out


def weekly_specs(delays: Sequence[int] = (1, 2, 3, 4)) -> dict[str, list[ModelSpec]]:
    """The weekly models by part: first stages, second stages by delay, two-lag models, measurement-error comparison."""
    y, z = "d_COVID_mortality_pc", "d_avg_precip"
    policies = ["EmergDec", "GathRestrictAny"]
    return {
        "first_stage": G.first_stage_specs(MEASURES, z, [*policies, f"{y}_m1"], "state_id", "week"),
        "second_stage": G.second_stage_specs(y, MEASURES, z, policies, delays, "state_id", "week"),
        "two_lag": G.two_lag_specs(y, MEASURES, z, policies, (1, 3), "state_id"),
        "attenuation": G.attenuation_specs(y, "d_una_distance_m3", "d_dl_mobility_m3", f"{z}_m3", weekly_controls(), "state_id"),
    }


def weekly_controls(delay: int = 3) -> list[str]:
    return [f"EmergDec_m{delay}", f"GathRestrictAny_m{delay}", f"d_COVID_mortality_pc_m{delay + 1}"]


def weekly_suite(features: DataFrame, delays: Sequence[int] = (1, 2, 3, 4)) -> WeeklySuite:
    """First stages, second stages by delay, two-lag models, measurement-error comparison and the
    test that two measures have the same effect."""
    parts = weekly_specs(delays)
    fits = G.run_grid(features, [s for specs in parts.values() for s in specs])  # one pass for all

    def part(specs):
        names = {s.name for s in specs}
        return G.GridResult(
            [f for f in fits.fits if f.spec.name in names],
            fits.coefficients.filter(F.col("model_id").isin(*names)),
            fits.models.filter(F.col("model_id").isin(*names)),
        )

    measures = ("d_dl_mobility_m3", "d_una_distance_m3")
    _, equal = G.equality_test(features, "d_COVID_mortality_pc", measures, "d_avg_precip_m3", weekly_controls(), "state_id")
    return WeeklySuite(*map(part, parts.values()), equal)


def reduced_form_spec(delay: int = 2) -> ModelSpec:
    """Reduced form with week effects and differenced policies."""
    used = ("EmergDec", "SchoolClose", "GathRestrictAny", "RestaurantRestrict", "StayAtHome", "NEBusinessClose")
    return ModelSpec(
        "reduced_form_week",
        "d_COVID_mortality_pc",
        [f"d_avg_precip_m{delay}", *[f"d_{p}_m{delay}" for p in used]],
        entity="week",
        constant=False,
    )


def daily_features(panel: DataFrame) -> DataFrame:
    """Differences and lags of the daily panel; lagged measures are divided by 100,000."""
    df = panel.withColumns(
        {
            "COVID_mortality_pc": safe_div("COVID_mortality", "population"),
            "precip": F.col("avg_precip"),
            "una": F.col("una_distance"),
            "dl": F.col("dl_mobility"),
            "twit": F.col("twitter_social_distancing"),
        }
    )

    def on(d):
        return Panel(d, "state", "date")

    df = difference(on(df), ["precip", "una", "dl", "twit", "COVID_mortality_pc"])
    df = log_difference(on(df), ["COVID_mortality"])
    df = lag_by(on(df), ["precip", "COVID_mortality_pc", "d_log_COVID_mortality"], [1])
    df = lagged_differences(on(df), ["una", "dl", "twit"], [1, 2], scale=100000.0)
    df = lagged_differences(on(df), ["precip"], [1, 2])
    return materialize(lagged_differences(on(df), ["COVID_mortality_pc"], [1, 2, 3]), "daily-features")


def daily_specs() -> list[ModelSpec]:
    """First stages (plain, squared, with policies), endogenous, reduced form and second stages."""
    y = "d_COVID_mortality_pc"
    measures = ("d_una", "d_dl", "d_twit")
    out = G.daily_first_stage_specs(measures, "d_precip", "precip_m1", f"{y}_m1", "state_id")
    for m in measures:
        lag1 = "d_log_COVID_mortality_m1"
        out += [
            ModelSpec(f"log_{m}", m, ["d_precip", lag1, "population"], entity="state_id"),
            ModelSpec(f"square_{m}", m, [*poly("d_precip", 2), lag1, "population"], entity="state_id"),
            ModelSpec(f"squares_{m}", m, [*poly("d_precip", 2), *poly(lag1, 2), "population"], entity="state_id"),
            ModelSpec(f"level_fe_{m}", m, ["d_precip", "COVID_mortality_pc_m1", "population"], entity="state_id"),
            ModelSpec(f"level_{m}", m, ["d_precip", "COVID_mortality_pc_m1", "population"]),
            ModelSpec(f"change_fe_{m}", m, ["d_precip", f"{y}_m1", "population"], entity="state_id"),
            ModelSpec(f"change_{m}", m, ["d_precip", f"{y}_m1", "population"]),
        ]
    for p in ("GathRestrictAny", "OtherBusinessClose", "RestaurantRestrict", "NEBusinessClose"):
        out.append(ModelSpec(f"policy_{p}", "d_una", ["d_precip", f"{y}_m1", p], entity="state_id"))
    for d in (1, 2):
        control = f"{y}_m{d + 1}"
        for m in measures:
            w = f"{m}_m{d}"
            out += [
                ModelSpec(f"endog_a_{w}", y, [w]),
                ModelSpec(f"endog_b_{w}", y, [w], entity="state_id"),
                ModelSpec(f"endog_c_{w}", y, [w, control], entity="state_id"),
            ]
        z = f"d_precip_m{d}"
        out += [
            ModelSpec(f"reduced_a_{z}", y, [z]),
            ModelSpec(f"reduced_b_{z}", y, [z], entity="state_id"),
            ModelSpec(f"reduced_c_{z}", y, [z, f"{y}_m2"], entity="state_id"),
        ]
        out += G.daily_second_stage_specs(y, measures, "d_precip", control, "state_id", d)
    return out


def daily_suite(features: DataFrame) -> tuple[G.GridResult, DataFrame]:
    """All daily models and the two-period second-stage table."""
    result = G.run_grid(features, daily_specs())
    return result, coef_table(result.coefficients, result.models, *daily_table())


def daily_table() -> tuple[list[str], list[str]]:
    """Roles and models of the two-period second-stage table."""
    return ["mobility_m2", "d_COVID_mortality_pc_m3", "_cons"], [f"{k}_{m}_m2" for m in ("d_una", "d_dl", "d_twit") for k in "abc"]


def lag_selection(
    panel: DataFrame,
    measure: str,
    instrument: str,
    policies: Sequence[str],
    outcome: str,
    entity: str = "state_id",
    time: str = "week",
    order: Sequence[str] = ("date",),
    lags: int = 4,
    folds: int = 10,
    excluded: Sequence[str] = NOT_STATES,
    fold: Column | None = None,
) -> tuple[LassoCV, LassoPath]:
    """Projection on the instrument, partialling-out of the controls, lags, cross-validated LASSO. ``fold`` may deal the rows by their
    state and order columns."""
    df = keep_not_in(panel, "state", list(excluded)) if excluded else panel
    trend = {"entity": entity, "trend": (time, 2)}
    df = fitted(df, ModelSpec("projection", measure, [instrument, *policies], **trend), "hat")
    df = residualize(df, ModelSpec("partial", "hat", list(policies), **trend), "hat_resid")
    df = lag_by(Panel(df, "state", tuple(order)), ["hat_resid"], range(1, lags + 1))
    x = [f"hat_resid_m{k}" for k in range(1, lags + 1)]
    keys = ["state", *order]
    data = materialize(standardize(complete_cases(df, x).select(*keys, outcome, *x), outcome, x), "lasso")
    return cv_lasso(data, outcome, x, keys, folds, fold=fold), lasso_path(data, outcome, x)


def country_specs() -> list[ModelSpec]:
    """First stages of rising degree, checks, endogenous and reduced forms, two-stage models."""
    s, h, pop, gdp = "normalized_safety", "normalized_hqi", "pop_thousands", "gdp_per_capita"

    def ld(degree, only=None):
        return poly("log_deaths", degree, only=only)

    out = [
        ModelSpec("fs_1", s, ["log_deaths"]),
        ModelSpec("fs_2", s, ["log_deaths", h]),
        ModelSpec("fs_3", s, ["log_deaths", h, pop]),
        ModelSpec("fs_quadratic", s, [*ld(2), h]),
        ModelSpec("fs_cubic", s, [*ld(3), h, pop]),
        ModelSpec("fs_cubic_pop", s, [*ld(3), pop]),
        ModelSpec("fs_cubic_only", s, ld(3)),
        ModelSpec("fs_quartic", s, [*ld(4), h, pop]),
        ModelSpec("check_square", "log_deaths", [h, *ld(2, [2])]),
        ModelSpec("check_cube", "log_deaths", [h, *ld(3, [2, 3])]),
        ModelSpec("square_on_rest", ld(2, [2])[0], [h, *ld(3, [1, 3])]),
        ModelSpec("cube_on_rest", ld(3, [3])[0], [h, *ld(2)]),
        ModelSpec("fs_gdp", s, [*ld(3), h, pop, gdp]),
        ModelSpec("fs_final", s, [*ld(3), h, *poly(pop, 2), gdp]),
    ]
    for y in ("log_covid_deaths", "log_covid_infections"):
        cube = ld(3, [3])
        out += [
            ModelSpec(f"endog_{y}", y, [s, h, pop, gdp]),
            ModelSpec(f"reduced_{y}", y, [*cube, h, pop, gdp]),
            ModelSpec(f"iv_{y}", y, [h], [s], cube),
        ]
    out.append(ModelSpec("iv_over", "log_covid_deaths", [h, pop, gdp], [s], ld(3)))
    out.append(ModelSpec("iv_full", "log_covid_infections", [h, pop, gdp], [s], ld(3, [3])))
    return out


def country_suite(cross: DataFrame) -> tuple[G.GridResult, TestResult]:
    result = G.run_grid(cross, country_specs())
    joint = test_joint(result["fs_final"], ["log_deaths", "log_deaths^2", "log_deaths^3"])
    return result, joint


def weekly_search_specs(measure: str = "dl_mobility") -> list[ModelSpec]:
    """Differenced against level controls, delays of 1–3 weeks, infections as outcome."""
    six = ("EmergDec", "SchoolClose", "GathRestrictAny", "RestaurantRestrict", "StayAtHome", "NEBusinessClose")
    y, m, z = "d_COVID_mortality_pc", f"d_{measure}", "d_avg_precip"
    cl = {"vce": "cluster", "cluster": "state_id"}
    fe = {**cl, "entity": "state_id"}
    out = [
        ModelSpec("fs_differenced", m, [z, *[f"d_{p}" for p in six], f"{y}_m1", f"{y}_m2"], **cl),
        reduced_form_spec(2),
        ModelSpec("fs_main", m, [z, "d_EmergDec", "d_GathRestrictAny", f"{y}_m1"], **fe),
        ModelSpec("ss_differenced", y, ["d_EmergDec_m2", "d_GathRestrictAny_m2", f"{y}_m3"], [f"{m}_m2"], [f"{z}_m2"], **fe),
        ModelSpec("ss_levels", y, ["EmergDec_m2", "GathRestrictAny_m2", f"{y}_m3"], [f"{m}_m2"], [f"{z}_m2"], **fe),
        ModelSpec(
            "ss_levels_una", y, ["EmergDec_m2", "GathRestrictAny_m2", f"{y}_m3"], ["d_una_distance_m2"], [f"{z}_m2"], **fe
        ),
    ]
    for outcome in ("d_COVID_mortality_pc", "d_COVID_infections_pc"):
        for d in (1, 2, 3):
            time = [] if (outcome == y and d == 2) else poly("week", 2)
            x = [*[f"d_{p}_m{d}" for p in six], f"{outcome}_m{d + 1}", *time]
            out.append(ModelSpec(f"{outcome}_m{d}", outcome, x, [f"{m}_m{d}"], [f"{z}_m{d}"], **cl))
    return out


def weekly_search(features: DataFrame) -> G.GridResult:
    """The search grid plus the first stage with entity and week effects."""
    result = G.run_grid(features, weekly_search_specs())
    return result.with_fits([fit_two_way(features, two_way_spec(), "week")])


def two_way_spec() -> ModelSpec:
    """The first stage that has entity and week effects."""
    six = ["EmergDec", "SchoolClose", "GathRestrictAny", "RestaurantRestrict", "StayAtHome", "NEBusinessClose"]
    return ModelSpec("fs_levels_two_way", "d_dl_mobility", ["d_avg_precip", *six], entity="state_id", vce="cluster", cluster="state_id")


def state_iv_specs(mean_temp: str = "Influenza_Tavg", senior: str = "65+") -> list[ModelSpec]:
    """Policy strength and social distancing designs of the state cross-section."""
    flu = "ln(double(Influenza_Deaths_Share))"  # NULL for zero
    log_flu, log_flu2, delay = ("log_flu", flu), ("log_flu^2", f"{flu} * {flu}"), ("log_delay", "ln(double(ndays_first_uscase))")
    x = [mean_temp, "Population", (senior, f"`{senior}`")]
    small = {"dof": "full"}
    return [
        ModelSpec("first_stage", delay, [log_flu, log_flu2, *x]),
        ModelSpec("reduced_form", "Early_Deaths_Share", [log_flu, log_flu2, *x]),
        ModelSpec("iv", "Early_Deaths_Share", x, [delay], [log_flu, log_flu2], vce="hc1", **small),
        ModelSpec("endogenous", "Corona_Deaths_Share", [delay, *x]),
        ModelSpec("first_stage_sd", "m50_index", [log_flu, *x]),
        ModelSpec("endogenous_sd", "Early_Deaths_Share", ["m50_index", *x]),
        ModelSpec("iv_sd", "Early_Deaths_Share", x, ["m50_index"], ["daily_distance_diff"], vce="hc1", **small),
    ]


def state_iv_suite(cross: DataFrame) -> tuple[G.GridResult, list[TestResult]]:
    """All models, and the diagnostics of the two-stage one under its robust errors."""
    specs = state_iv_specs()
    _, tests = robust_iv_diagnostics(cross, next(s for s in specs if s.name == "iv"))
    return G.run_grid(cross, specs), tests


def shift_share_suite(panel: DataFrame) -> G.GridResult:
    """Two-stage models with the level-form shift-share variable two weeks back as instrument."""
    df = panel.withColumn("US_other_mortality", F.col("US_total_mortality") - F.col("US_COVID_mortality"))
    df = per_capita(df, {"COVID_mortality": "COVID_mortality_pc"})

    def on(d):
        return Panel(d, "state", ("year", "week"))

    df = shift_share_levels(on(df), "COVID_mortality_frac", "US_COVID_mortality", "US_other_mortality", "bartik")
    df = difference(on(df), ["COVID_mortality_pc", "una_distance"])
    df = log_difference(on(df), ["COVID_mortality"])
    df = lag_by(on(df), ["bartik", "d_una_distance"], [2])
    df = lagged_differences(on(df), ["COVID_mortality_pc"], [2, 3])
    return G.run_grid(materialize(df, "shift-share"), shift_share_specs())


def shift_share_specs() -> list[ModelSpec]:
    y = "d_COVID_mortality_pc"
    return [
        ModelSpec("mobility", y, [f"{y}_m3"], ["d_una_distance_m2"], ["bartik_m2"], entity="state_id"),
        ModelSpec("own_lag", y, [], [f"{y}_m2"], ["bartik_m2"], entity="state_id"),
    ]


def state_year_week_specs() -> list[ModelSpec]:
    """Lagged mobility on the mortality share: endogenous fits, reduced form, first stages, one over-identified and two
    just-identified two-stage fits, all with robust errors."""
    y, z = "COVID_mortality_frac", "lagged_bartik"
    lagged = {"twitter": "lagged_twitter", "dist": "lagged_dist", "visit": "lagged_visit"}
    now = {"twitter": "twitter_social_distancing", "dist": "distance_diff", "visit": "visitation_diff"}
    out = [ModelSpec(f"endogenous_{k}", y, [c]) for k, c in lagged.items()]
    out.append(ModelSpec("reduced_form", y, [z]))
    out += [ModelSpec(f"first_stage_{k}", c, ["bartik"]) for k, c in now.items()]
    out.append(ModelSpec("iv_twitter", y, (), [lagged["twitter"]], [z, lagged["dist"], lagged["visit"]]))
    out += [ModelSpec(f"iv_{k}", y, (), [lagged[k]], [z]) for k in ("dist", "visit")]
    return out


def state_year_week_suite(panel: DataFrame) -> G.GridResult:
    """``panel`` as ``plans.panels.state_year_week`` makes it."""
    return G.run_grid(panel, state_year_week_specs())
