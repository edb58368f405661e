"""Clean tables from raw files. Every builder takes the raw table and returns the clean one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    ascii_only,
    count_from_text,
    month_start,
    parse_mdy2,
    parse_ymd,
    safe_div,
    sentinel_to_null,
    sum_zero,
    tolerant_cast,
)
from ..functions.state_codes import STATE_NAMES
from ..operators.aggregates import pooled_rate, share_of_group
from ..operators.clean import columns_from, recode
from ..operators.joins import copy_reference_row
from ..operators.reshape import mapping_table, to_long, union_all
from ..sources.readers import read_report_matrix

# Cause codes of the two groups of communicable causes (fixed values).
INFECTION_CODES = (20, 380)
PREDICTED = "Predicted (weighted)"
ALL_CAUSES = "All causes"
SUPPRESSED_COUNTS = "Suppressed (counts 1-9)"


def epidemic_rates(reports: Mapping[int, DataFrame], entities: Sequence[str], first_row: int, last_row: int) -> DataFrame:
    """Infection deaths per person, pooled over yearly reports by country.

    A report has a row number, a cause code (none on the population row) and a column per country,
    in thousands. Years are matched on the country: deaths are summed, population is averaged.
    """
    codes = {"pop_thousands": [None], "deaths_thousands": list(INFECTION_CODES)}
    parts = [
        read_report_matrix(df, "row_id", first_row, last_row, "code", codes, entities, "country")
        for _, df in sorted(reports.items())
    ]
    pooled = pooled_rate(union_all(parts), "country", "deaths_thousands", "pop_thousands", len(parts), "infection_deaths")
    return pooled


def health_index(raw: DataFrame, indicator: str, year: int) -> DataFrame:
    return raw.filter((F.col("indicator_name") == indicator) & (F.col("year_id") == year)).select(
        F.col("location_name").alias("country"), F.col("val").alias("hqi")
    )


def safety_ratings(regions: Sequence[DataFrame]) -> DataFrame:
    """Positional region files (rank, country, score) stacked; the rank is dropped."""
    return union_all(list(regions)).select("country", F.col("score").alias("covid_safety"))


def country_counts(wide: DataFrame, date_col: str, name: str) -> DataFrame:
    """Whole-country rows of a wide count file at one date."""
    return wide.filter(F.col("`Province/State`").isNull()).select(
        F.col("`Country/Region`").alias("country"), F.col(f"`{date_col}`").alias(name)
    )


def us_counts_long(wide: DataFrame, first_date: int, name: str, entity: str = "Province_State") -> DataFrame:
    """Wide county file (a column per day from a position on) → (state, date, value)."""
    days = columns_from(wide, first_date)
    long = to_long(wide.select(F.col(entity).alias("state"), *[F.col(f"`{d}`") for d in days]), ["state"], days, "date", name)
    return long.withColumn("date", parse_mdy2("date"))


def us_population(wide: DataFrame) -> DataFrame:
    """County rows; they are summed per state where they are used."""
    return wide.select(F.col("Province_State").alias("state"), F.col("Population").alias("population"))


def gdp_per_capita(raw: DataFrame, year: str, keep_ascii: bool = False) -> DataFrame:
    name = F.col("`Country Name`")
    return raw.select(
        (ascii_only(name) if keep_ascii else name).alias("country"),
        tolerant_cast(F.col(f"`{year}`"), "double").alias("gdp_per_capita"),
    )


def weekly_mortality(raw: DataFrame, national: str = "United States") -> DataFrame:
    """Weekly deaths by state with the national row's values on each row of the week."""
    keep = (
        (F.col("Type") == PREDICTED)
        & (F.col("Outcome") == ALL_CAUSES)
        & F.coalesce(F.col("Suppress") != SUPPRESSED_COUNTS, F.lit(True))
    )
    rows = raw.filter(keep).select(
        F.col("`Week Ending Date`").alias("date"),
        F.col("State").alias("state"),
        F.col("`Observed Number`").alias("total_mortality"),
        F.col("Excess").alias("COVID_mortality"),
    )
    rows = rows.withColumn("COVID_mortality_frac", safe_div("COVID_mortality", "total_mortality"))
    cols = ["total_mortality", "COVID_mortality", "COVID_mortality_frac"]
    return copy_reference_row(rows, "state", national, "date", cols, "US_")


def wide_mobility(wide: DataFrame, value: str, names: Mapping[str, str] = STATE_NAMES) -> DataFrame:
    """One column per state code → (date, state, value); codes are trimmed before the lookup."""
    date = wide.columns[0]
    long = to_long(wide, [date], None, "state", value).withColumnRenamed(date, "date")
    codes = mapping_table(wide.sparkSession, dict(names), "old", "new")
    return recode(long, "state", codes, trim=True)


def state_mobility(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("state_name").alias("state"), "state_population", "date", "daily_distance_diff", "daily_visitation_diff"
    )


def index_mobility(raw: DataFrame) -> DataFrame:
    """State-level rows of the index file; the index is divided by 100."""
    return raw.filter(F.col("admin_level") == 1).select(
        parse_ymd("date").alias("date"),
        F.col("admin1").alias("state"),
        F.col("m50").alias("dl_mobility"),
        (F.col("m50_index") / 100).alias("dl_mobility_relative_to_normal"),
    )


def rainfall(raw: DataFrame) -> DataFrame:
    return raw.select(parse_mdy2("Date").alias("date"), F.col("State").alias("state"), F.col("Avg_Precip").alias("avg_precip"))


def monthly_temperature(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("Location").alias("State"), month_start("Date").alias("Date"), sentinel_to_null("Value", -99.0).alias("Tavg")
    )


def influenza_deaths(raw: DataFrame) -> DataFrame:
    """Yearly deaths per state; suppressed months count as missing, all-missing years as 0."""
    deaths = tolerant_cast(sentinel_to_null("Deaths", "Suppressed"), "double")
    rows = raw.select("State", F.year(month_start("`Month Code`", "yyyy/MM")).alias("Year"), deaths.alias("d"))
    return rows.groupBy("State", "Year").agg(sum_zero("d").alias("Influenza_Deaths"))


def swine_flu(raw: DataFrame) -> DataFrame:
    """Counts freed of citation marks and separators; deaths come from the deaths column."""
    return raw.select(
        "State", count_from_text("Cases").alias("Swineflu_Cases"), count_from_text("Deaths").alias("Swineflu_Deaths")
    )


def population_shares(raw: DataFrame) -> DataFrame:
    """Population cells with their share of the state-year total."""
    rows = raw.select(
        "State",
        F.col("`Age Group Code`").alias("AgeGroup"),
        F.col("`Gender Code`").alias("Gender"),
        "Race",
        F.col("`Yearly July 1st Estimates Code`").alias("Year"),
        "Population",
    )
    return share_of_group(rows, ["State", "Year"], "Population", "PopShare", total="TotPop")
