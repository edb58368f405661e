"""One row per state or country."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div, safe_ln, scaled_log_rate, sum_strict
from ..operators.aggregates import band_rollup, one_row_per_key
from ..operators.clean import in_period, in_year, recode
from ..operators.joins import Side, join_all, max_after_first, merge_many, natural_join, up_to_event
from ..operators.panel import delay_index, delay_rows, zscore
from ..session import materialize

EARLY_DAYS = 30


def outbreak_summary(deaths: DataFrame, cases: DataFrame, days: int = EARLY_DAYS, national: bool = False) -> DataFrame:
    """County-day counts → one row per state with first dates, early and total counts and shares.

    ``deaths`` has (State, Date, Deaths, Population), ``cases`` (State, Date, Cases), one row per
    county and day. The series are cumulative, so totals are the last values. ``national=True``
    takes early counts over all states in the state's window.
    """
    d = deaths.groupBy("State", "Date").agg(
        sum_strict("Deaths").alias("Deaths"), sum_strict("Population").alias("Population")
    )
    c = cases.groupBy("State", "Date").agg(sum_strict("Cases").alias("Cases"))
    # Five aggregates read the state-day table, so it is written once.
    both = materialize(natural_join(d, c, "full_outer"), "outbreak-days")
    per_state = both.groupBy("State").agg(
        F.min(F.when(F.col("Cases") > 0, F.col("Date"))).alias("First_Case_Date"),
        F.min(F.when(F.col("Deaths") > 0, F.col("Date"))).alias("First_Death_Date"),
        F.max("Population").alias("Population"),
        F.max_by("Cases", F.when(F.col("Cases").isNotNull(), F.col("Date"))).alias("Corona_Cases"),
        F.max_by("Deaths", F.when(F.col("Deaths").isNotNull(), F.col("Date"))).alias("Corona_Deaths"),
    )
    early_d = max_after_first(both, "State", "Date", "Deaths", days, "Early_Deaths", national)
    early_c = max_after_first(both, "State", "Date", "Cases", days, "Early_Cases", national)
    out = join_all([per_state, early_d, early_c], ["State"])
    return out.withColumns(
        {
            f"{c}_Share": safe_div(c, "Population")
            for c in ("Early_Deaths", "Early_Cases", "Corona_Cases", "Corona_Deaths")
        }
    )


def policy_delays(
    policy: DataFrame, outbreak: DataFrame, policies: Sequence[str], us_case: date, us_death: date
) -> DataFrame:
    """Mean days from four marks to the first state-wide mandate of each listed policy."""
    marks = outbreak.select("State", "First_Case_Date", "First_Death_Date")
    wanted = policy.filter(
        F.col("StatePolicy").isin(*policies) & (F.col("Mandate") == 1) & (F.col("StateWide") == 1)
    ).select("State", "StatePolicy", "DateIssued")
    # Every listed mandate is kept; states without one have no delay.
    rows = wanted.join(marks, ["State"], "left")
    return delay_index(
        delay_rows(rows, "State", "StatePolicy", "DateIssued", "First_Case_Date", "First_Death_Date", us_case, us_death), "State"
    )


def merged_mobility(first: DataFrame, second: DataFrame, first_cols: Sequence[str], second_cols: Sequence[str]) -> DataFrame:
    """Two sources as global z-scores, joined on (State, Date). A missing value in a source
    column makes that column missing, as its mean is."""
    a = zscore(first.select("State", "Date", *first_cols), {c: c for c in first_cols}, strict=True)
    b = zscore(second.select("State", "Date", *second_cols), {c: c for c in second_cols}, strict=True)
    return natural_join(a, b, "full_outer")


def state_cross_section(
    shares: DataFrame,
    temperature: DataFrame,
    swine: DataFrame,
    influenza: DataFrame,
    delays: DataFrame,
    mobility: DataFrame,
    outbreak: DataFrame,
    bands: Sequence[str],
    senior: Sequence[str],
    share_year: int,
    flu_year: int,
    season: tuple[date, date],
    mobility_cols: Sequence[str],
    days: int = 14,
) -> DataFrame:
    """Inner join of the state features: age shares, temperatures, past epidemics, policy delay,
    mobility in the two weeks after the first case, outbreak. The inputs are clean tables; some
    are read twice, so they should be written ones."""
    ages = band_rollup(
        shares.filter(F.col("Year") == share_year), ["State"], "AgeGroup", "PopShare", bands, {"65+": list(senior)}
    )
    totals = shares.groupBy("State", "Year").agg(F.max("TotPop").alias("TotPop"))
    swine_share = (
        swine.join(totals.filter(F.col("Year") == share_year), ["State"])
        .withColumns(
            {
                "Swineflu_Case_Share": safe_div("Swineflu_Cases", "TotPop"),
                "Swineflu_Deaths_Share": safe_div("Swineflu_Deaths", "TotPop"),
            }
        )
        .drop("TotPop", "Year")
    )
    flu_share = (
        influenza.join(totals, ["State", "Year"])
        .filter(F.col("Year") == flu_year)
        .select("State", "Influenza_Deaths", safe_div("Influenza_Deaths", "TotPop").alias("Influenza_Deaths_Share"))
    )
    swine_temp = in_period(temperature, "Date", *season).groupBy("State").agg(F.avg("Tavg").alias("Swineflu_Tavg"))
    flu_temp = in_year(temperature, "Date", flu_year).groupBy("State").agg(F.avg("Tavg").alias("Influenza_Tavg"))
    near = up_to_event(mobility, outbreak, "State", "Date", "First_Case_Date", days)
    near = near.groupBy("State").agg(*[F.avg(c).alias(c) for c in mobility_cols])
    rest = outbreak.drop("First_Case_Date", "First_Death_Date")
    return join_all([swine_temp, ages, flu_temp, swine_share, flu_share, delays, near, rest], ["State"])


# Country names that differ between the sources (fixed values).
EPIDEMIC_NAMES = {
    "Lao People's Democratic Republic": "Laos",
    "United Kingdom": "UK",
    "Viet Nam": "Vietnam",
    "Republic of Korea": "South Korea",
}
HEALTH_NAMES = {"Czech Republic": "Czechia", "United Kingdom": "UK"}
COUNT_NAMES = {"United Kingdom": "UK", "Korea, South": "South Korea", "Taiwan*": "Taiwan", "Burma": "Myanmar"}
GDP_NAMES = {
    "Czech Republic": "Czechia",
    "United Kingdom": "UK",
    "Korea, Rep.": "South Korea",
    "Lao PDR": "Laos",
    "Slovak Republic": "Slovakia",
}


def country_cross_section(
    safety: DataFrame,
    epidemic: DataFrame,
    health: DataFrame,
    infections: DataFrame,
    deaths: DataFrame,
    gdp: DataFrame,
    names: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Countries present in all six tables, with normalised scores and log rates.

    Health rows are made distinct and cut to one row per country in a fixed order.
    """
    maps = names or {
        "epidemic": EPIDEMIC_NAMES,
        "health": HEALTH_NAMES,
        "infections": COUNT_NAMES,
        "deaths": COUNT_NAMES,
        "gdp": GDP_NAMES,
    }
    one_health = one_row_per_key(health.distinct(), ["country"], ["hqi"])
    sides = [
        Side(recode(epidemic, "country", maps["epidemic"]), keep="matched"),
        Side(recode(one_health, "country", maps["health"]), keep="matched"),
        Side(recode(infections, "country", maps["infections"]), keep="matched"),
        Side(recode(deaths, "country", maps["deaths"]), keep="matched"),
        Side(recode(gdp, "country", maps["gdp"]), keep="matched"),
    ]
    out = merge_many(safety, sides, ["country"])
    out = zscore(materialize(out, "countries"), {"covid_safety": "normalized_safety", "hqi": "normalized_hqi"})
    people = F.col("pop_thousands") * 1000
    return out.withColumns(
        {
            "log_deaths": safe_ln(10000 * F.col("infection_deaths")),
            "log_covid_deaths": scaled_log_rate("covid_deaths", people, 10000),
            "log_covid_infections": scaled_log_rate("covid_infections", people, 10000),
        }
    )
