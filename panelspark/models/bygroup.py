"""Simple regressions per group and cross-source agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from .linear import ols
from .spec import FitResult


def ols_by(df: DataFrame, group: str | Sequence[str], y: str, x: str) -> DataFrame:
    """Slope of y on x in every group with HC2 errors.

    Two aggregates: the first gives the fits, the second the weighted squared residuals. The
    small table of fits is joined to the rows, so a large group is spread over many tasks.
    """
    by = [group] if isinstance(group, str) else list(group)
    rows = df.select(*by, F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")).na.drop()
    fits = rows.groupBy(*by).agg(
        F.regr_count("y", "x").alias("n"),
        F.regr_avgx("y", "x").alias("xm"),
        F.regr_sxx("y", "x").alias("sxx"),
        F.regr_slope("y", "x").alias("estimate"),
        F.regr_intercept("y", "x").alias("intercept"),
    )
    dx = F.col("x") - F.col("xm")
    lev = 1.0 / F.col("n") + safe_div(dx * dx, "sxx")
    err = F.col("y") - F.col("intercept") - F.col("estimate") * F.col("x")
    # A point with leverage one has no defined HC2 weight; the group's error is then missing.
    room = F.when(1.0 - lev > 1e-10, 1.0 - lev)
    term = safe_div(dx * dx * err * err, room)
    return (
        rows.join(fits, by)
        .groupBy(*by)
        .agg(
            F.max("n").alias("n"),
            F.max("estimate").alias("estimate"),
            F.max("intercept").alias("intercept"),
            F.sqrt(safe_div(F.when(F.count(term) == F.count(F.lit(1)), F.sum(term)), F.max(F.col("sxx") * F.col("sxx")))).alias(
                "std_error"
            ),
        )
        .withColumn("statistic", safe_div("estimate", "std_error"))
        .select(*by, "n", "estimate", "intercept", "std_error", "statistic")
    )


def agreement(df: DataFrame, group: str, y: str, x: str) -> tuple[FitResult, DataFrame]:
    """Do two sources measure the same thing? Pooled HC2 regression and one per group."""
    return ols(df, y, [x], name="pooled", vce="hc2"), ols_by(df, group, y, x)


def tidy_term(coefs: DataFrame, term: str) -> DataFrame:
    """One term of every model."""
    return coefs.filter(F.col("term") == term)
