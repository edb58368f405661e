"""Plot-ready extracts: small tables a chart can be drawn from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reshape import to_long


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width bins over [lo, hi] with counts and the mean of the column on each row.

    Missing bounds are taken from the data (one aggregate). Values at the upper bound fall in
    the last bin; values outside given bounds fall in bin 0 or bins + 1.
    """
    stats = df.agg(
        F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"), F.avg(col).alias("mean")).alias("stats")
    ).scalar()
    low = F.lit(float(lo)) if lo is not None else stats["lo"].cast("double")
    high = F.lit(float(hi)) if hi is not None else stats["hi"].cast("double")
    x = F.col(col).cast("double")
    raw = F.width_bucket(x, low, high, F.lit(bins)).cast("int")
    counts = (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.when(x == high, F.lit(bins)).otherwise(raw).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (high - low) / bins
    return counts.select("bin", (low + width * (F.col("bin") - 0.5)).alias("mid"), "n", stats["mean"].alias("mean"))


def fitted_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of y on x over the rows where both are present."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n")
    )


def scatter(df: DataFrame, x: str, y: str, x_range: tuple[float, float] | None = None) -> DataFrame:
    """Points within the axis limits with the fitted line of those points on each row."""
    pts = df.select(F.col(x).alias("x"), F.col(y).alias("y")).na.drop()
    if x_range:
        pts = pts.filter(F.col("x").between(*x_range))
    line = fitted_line(pts, "x", "y").select(F.struct("slope", "intercept").alias("line")).scalar()
    return pts.select(
        "x",
        "y",
        line["slope"].alias("slope"),
        line["intercept"].alias("intercept"),
        (line["intercept"] + line["slope"] * F.col("x")).alias("line"),
    )


def series(df: DataFrame, time: str, cols: Mapping[str, str | Column], entity: Column | None = None) -> DataFrame:
    """Several columns as one long table (time, series, value), optionally of one entity."""
    rows = df if entity is None else df.filter(entity)
    wide = rows.select(time, *[(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for n, c in cols.items()])
    return to_long(wide, [time], list(cols), "series", "value")


def with_markers(lines: DataFrame, events: DataFrame, time: str, label: str) -> DataFrame:
    """Append event dates as rows of kind 'event' to the line rows of kind 'line'."""
    a = lines.withColumn("kind", F.lit("line"))
    b = events.select(
        F.col(time), F.col(label).alias("series"), F.lit(None).cast("double").alias("value"), F.lit("event").alias("kind")
    )
    return a.unionByName(b)


def bars(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias(name))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations, one row per pair, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    out = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    long = out.unpivot([], [F.col(f"`{a}|{b}`") for a, b in pairs], "pair", "corr")
    parts = F.split("pair", r"\|")
    return long.select(parts[0].alias("var1"), parts[1].alias("var2"), "corr")


def curve_grid(spark, lo: float, hi: float, n: int, coefficients: Mapping[int, float], log10: bool = False) -> DataFrame:
    """Values of a fitted polynomial on an even grid. ``coefficients`` maps degree to value;
    with ``log10`` the grid is even in log10 and the value is taken back to levels."""
    steps = spark.range(n).select((F.lit(lo) + F.col("id") * F.lit((hi - lo) / (n - 1))).alias("x"))
    y = F.lit(0.0)
    for degree, value in sorted(coefficients.items()):
        term = F.lit(float(value))
        for _ in range(degree):
            term = term * F.col("x")
        y = y + term
    out = steps.withColumn("y", y)
    return out.select(F.pow(F.lit(10.0), "x").alias("x"), F.pow(F.lit(10.0), "y").alias("y")) if log10 else out
