"""Coefficient tables: terms down, models across."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reshape import literal_table

# Significance marks (fixed levels).
STAR_LEVELS = ((0.01, "***"), (0.05, "**"), (0.10, "*"))


def stars(p: Column) -> Column:
    out = None
    for level, mark in STAR_LEVELS:
        out = F.when(p < level, mark) if out is None else out.when(p < level, mark)
    return out.otherwise("")


def number_text(value: Column, style: str, digits: int) -> Column:
    """'f' fixed with thousands separators, 'e' scientific; minus is written as two dashes."""
    pattern = f"%,.{digits}f" if style == "f" else f"%.{digits}e"
    return F.when(value.isNotNull(), F.regexp_replace(F.format_string(pattern, value), "^-", "--"))


def coef_table(
    coefs: DataFrame,
    models: DataFrame,
    order: Sequence[str],
    model_ids: Sequence[str],
    labels: Mapping[str, str] | None = None,
    style: str = "f",
    digits: int = 3,
) -> DataFrame:
    """Rows: each kept role with estimate and stars, below it the error in parentheses; then N,
    R² and adjusted R². Columns: the models in the given order. ``row`` gives the row order."""
    spark = coefs.sparkSession
    names = labels or {}
    terms = literal_table(spark, [(t, i, names.get(t, t)) for i, t in enumerate(order)], "role string, at int, label string")
    cells = coefs.filter(F.col("model_id").isin(*model_ids)).join(F.broadcast(terms), ["role"])
    shown = cells.select(
        "model_id",
        F.explode(
            F.array(
                F.struct(
                    (F.col("at") * 2).alias("row"),
                    F.col("label").alias("label"),
                    F.concat(number_text(F.col("estimate"), style, digits), stars(F.col("p_value"))).alias("cell"),
                ),
                F.struct(
                    (F.col("at") * 2 + 1).alias("row"),
                    F.lit("").alias("label"),
                    F.concat(F.lit("("), number_text(F.col("std_error"), style, digits), F.lit(")")).alias("cell"),
                ),
            )
        ).alias("c"),
    ).select("model_id", "c.*")
    last = 2 * len(order)
    stats = models.filter(F.col("model_id").isin(*model_ids)).select(
        "model_id",
        F.explode(
            F.array(
                F.struct(F.lit(last).alias("row"), F.lit("N").alias("label"), F.format_string("%,d", F.col("n")).alias("cell")),
                F.struct(
                    F.lit(last + 1).alias("row"), F.lit("R2").alias("label"), number_text(F.col("r2"), "f", 3).alias("cell")
                ),
                F.struct(
                    F.lit(last + 2).alias("row"),
                    F.lit("Adj. R2").alias("label"),
                    number_text(F.col("adj_r2"), "f", 3).alias("cell"),
                ),
            )
        ).alias("c"),
    ).select("model_id", "c.*")
    return (
        shown.unionByName(stats).groupBy("row", "label").pivot("model_id", list(model_ids)).agg(F.first("cell"))
    )


def with_header(table: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """The table with two lines above it: the column group of each model, told once over its first column, and the models'
    numbers. Columns follow the order of the groups."""
    members = [(m, g if i == 0 else "") for g, ms in groups.items() for i, m in enumerate(ms)]
    names = ["row", "label", *[m for m, _ in members]]
    lines = [(-2, "", *[g for _, g in members]), (-1, "", *[f"({i})" for i in range(1, len(members) + 1)])]
    schema = ", ".join(["row int", "label string", *[f"`{m}` string" for m, _ in members]])
    head = table.sparkSession.createDataFrame(lines, schema)
    return head.unionByName(table.select(*[F.col(f"`{c}`") for c in names]))
