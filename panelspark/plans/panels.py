"""State × period panels built from the clean tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div, sum_zero, week52
from ..operators.aggregates import two_level
from ..operators.clean import drop_blank
from ..operators.joins import Side, merge, merge_many
from ..operators.panel import (
    Panel,
    chain_index,
    changes,
    fill_forward,
    lag_by,
    shift_share,
    step_panel,
    with_dense_id,
    zscore,
    zscore_panel,
)
from ..session import materialize

# Policy columns of the step panel (fixed names).
POLICIES = (
    "EmergDec",
    "SchoolClose",
    "GathRestrictAny",
    "OtherBusinessClose",
    "RestaurantRestrict",
    "StayAtHome",
    "NEBusinessClose",
)
PANEL_START, PANEL_END = date(2020, 1, 22), date(2020, 4, 22)
WEEK_KEYS = ["state", "year", "week"]


def policy_panel(
    policy: DataFrame, policies: Sequence[str] = POLICIES, start: date = PANEL_START, end: date = PANEL_END
) -> DataFrame:
    """Daily 0/1 columns per policy from the first mandate on."""
    rows = policy.withColumnRenamed("StateName", "state")
    return step_panel(rows, "state", "StatePolicy", "DateEnacted", policies, start, end, counts=F.col("Mandate") == 1)


def with_week(df: DataFrame, col: str = "date") -> DataFrame:
    """Year and 52-week number always travel together."""
    return df.withColumns({"year": F.year(col), "week": week52(col)})


def weekly_mean(df: DataFrame, cols: Sequence[str], year: int | None = None) -> DataFrame:
    rows = with_week(df)
    if year is not None:
        rows = rows.filter(F.col("year") == year)
    return rows.groupBy(*WEEK_KEYS).agg(*[F.avg(c).alias(c) for c in cols])


def _weekly_counts(df: DataFrame, value: str, first_date: str | None) -> DataFrame:
    return two_level(with_week(df), ["state", "date"], WEEK_KEYS, value, "date", first_date)


def _population(county: DataFrame) -> DataFrame:
    return county.groupBy("state").agg(sum_zero("population").alias("population"))


def _scored(df: DataFrame, time: tuple[str, ...], *cols: str) -> DataFrame:
    return zscore_panel(Panel(df, "state", time), {c: c for c in cols})


def state_week_panel(
    deaths: DataFrame,
    infections: DataFrame,
    population: DataFrame,
    mortality: DataFrame,
    mobility: DataFrame,
    twitter: DataFrame,
    index: DataFrame,
    rain: DataFrame,
    policy: DataFrame,
    year: int | None = None,
    policies: Sequence[str] = POLICIES,
    across_entities: bool = False,
) -> DataFrame:
    """Eight-source weekly panel.

    Counts are summed over counties per day, then averaged over the week. Mobility levels are
    turned into percent and log changes before they become z-scores within the state. Each side
    is aggregated to its keys before it is joined, and all sides share the panel's one shuffle.
    """
    base = _weekly_counts(deaths, "COVID_mortality", "date")
    cases = _weekly_counts(infections, "COVID_infections", None)
    deaths_all = with_week(mortality)
    if year is not None:
        deaths_all = deaths_all.filter(F.col("year") == year)
    deaths_all = deaths_all.select(*WEEK_KEYS, "COVID_mortality_frac", "US_COVID_mortality", "US_total_mortality")

    una = with_week(mobility).groupBy(*WEEK_KEYS).agg(
        F.avg(F.col("daily_distance_diff") + 1).alias("una_distance"),
        F.avg(F.col("daily_visitation_diff") + 1).alias("una_visitation"),
    )
    una = changes(
        Panel(una, "state", ("year", "week")),
        {
            "una_distance": ("una_pct_distance", "una_log_distance"),
            "una_visitation": ("una_pct_visitation", "una_log_visitation"),
        },
        across_entities,
    )
    una = _scored(una, ("year", "week"), "una_distance", "una_visitation")
    twit = weekly_mean(twitter, ["twitter_social_distancing"], year)
    twit = _scored(twit, ("year", "week"), "twitter_social_distancing")
    dl = _scored(weekly_mean(index, ["dl_mobility"]), ("year", "week"), "dl_mobility")
    wet = weekly_mean(rain, ["avg_precip"])
    flags = with_week(drop_blank(policy, "state")).groupBy(*WEEK_KEYS).agg(*[F.max(p).alias(p) for p in policies])

    # Written: the merge below reads its left side twice.
    out = materialize(merge(base, cases, WEEK_KEYS, keep="all", left_unique=True, right_unique=True), "week-counts")
    out = merge(out, _population(population), ["state"], card="m:1", keep="all", right_unique=True)
    out = merge_many(
        out,
        [
            Side(deaths_all, card="m:1"),
            Side(una, known_unique=True),
            Side(twit, known_unique=True),
            Side(dl, known_unique=True),
            Side(wet, known_unique=True),
            Side(flags, known_unique=True),
        ],
        WEEK_KEYS,
        left_unique=True,
    )
    # Written once: the id step and everything later read the table, not the eight sources.
    return with_dense_id(materialize(out, "state-week"), "state", "state_id")


def state_day_panel(
    deaths: DataFrame,
    infections: DataFrame,
    population: DataFrame,
    mobility: DataFrame,
    twitter: DataFrame,
    index: DataFrame,
    rain: DataFrame,
    policy: DataFrame,
    policies: Sequence[str] = POLICIES,
) -> DataFrame:
    """Seven-source daily panel; the sparse source is filled forward within the state."""
    keys = ["state", "date"]
    base = deaths.groupBy(*keys).agg(sum_zero("COVID_mortality").alias("COVID_mortality"))
    cases = infections.groupBy(*keys).agg(sum_zero("COVID_infections").alias("COVID_infections"))
    una = mobility.select(
        *keys,
        "state_population",
        (F.col("daily_distance_diff") + 1).alias("una_distance"),
        (F.col("daily_visitation_diff") + 1).alias("una_visitation"),
    )
    una = _scored(una, ("date",), "una_distance", "una_visitation")
    twit = _scored(twitter, ("date",), "twitter_social_distancing")
    dl = _scored(index, ("date",), "dl_mobility")

    # Written: the merge below reads its left side twice.
    out = materialize(merge(base, cases, keys, keep="all", left_unique=True, right_unique=True), "day-counts")
    out = merge(out, _population(population), ["state"], card="m:1", keep="all", right_unique=True)
    out = merge_many(out, [Side(una), Side(twit)], keys, left_unique=True)
    out = fill_forward(Panel(out, "state", "date"), ["twitter_social_distancing"])
    out = merge_many(out, [Side(dl), Side(rain), Side(policy.select(*keys, *policies))], keys, left_unique=True)
    return with_dense_id(materialize(with_week(out), "state-day"), "state", "state_id")


def state_year_week(mortality: DataFrame, twitter: DataFrame, mobility: DataFrame) -> DataFrame:
    """Weekly mortality with two mobility sources, the chained weekly index of daily changes, the
    shift-share variable and one-row lags."""
    deaths = with_week(mortality).drop("date")
    twit = zscore(materialize(weekly_mean(twitter, ["twitter_social_distancing"]), "twitter"), {"twitter_social_distancing": "twitter_social_distancing"})
    daily = chain_index(
        with_week(mobility),
        WEEK_KEYS,
        ["date"],
        {"daily_distance_diff": "distance_diff", "daily_visitation_diff": "visitation_diff"},
    )
    una = daily.groupBy(*WEEK_KEYS).agg(
        F.max_by("distance_diff", "date").alias("distance_diff"),
        F.max_by("visitation_diff", "date").alias("visitation_diff"),
        F.avg("state_population").alias("state_population"),
    )
    una = zscore(materialize(una, "mobility"), {"distance_diff": "distance_diff", "visitation_diff": "visitation_diff"})
    out = merge_many(
        deaths,
        [Side(twit, keep="all", known_unique=True), Side(una, keep="all", known_unique=True, indicator="_merge")],
        WEEK_KEYS,
    )
    out = shift_share(Panel(out, "state", ("year", "week")), "COVID_mortality_frac", "US_COVID_mortality_frac", "bartik")
    out = out.withColumn("COVID_per_capita", safe_div("COVID_mortality", "state_population"))
    lagged = {
        "twitter_social_distancing": "lagged_twitter",
        "distance_diff": "lagged_dist",
        "visitation_diff": "lagged_visit",
        "bartik": "lagged_bartik",
    }
    out = lag_by(Panel(out, "state", ("year", "week")), list(lagged), [1])
    out = out.withColumnsRenamed({f"{c}_m1": name for c, name in lagged.items()})
    return with_dense_id(materialize(out, "state-year-week"), "state", "state_id")


def per_capita(panel: DataFrame, counts: Mapping[str, str], population: str = "population") -> DataFrame:
    return panel.withColumns({name: safe_div(c, population) for c, name in counts.items()})
