"""File scans with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import to_long


def _with_schema(reader, schema: str | T.StructType):
    return reader.schema(schema)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, **options) -> DataFrame:
    """Headered comma-separated scan. Columns that are not used later are not parsed."""
    reader = spark.read.option("header", True).option("enforceSchema", False).options(**options)
    return _with_schema(reader, schema).csv(path)


def read_tsv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, **options) -> DataFrame:
    """Headered tab-separated scan."""
    return read_csv(spark, path, schema, sep="\t", **options)


def read_positional_tsv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """Tab-separated scan without header; the schema names the columns by position."""
    return spark.read.option("header", False).option("sep", "\t").schema(schema).csv(path)


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a wide file whose columns grow with time (reads the first line only)."""
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def read_wide_csv(
    spark: SparkSession, path: str | Sequence[str], id_types: dict[str, str], value_type: str, sep: str = ","
) -> DataFrame:
    """Wide matrix files: known id columns, every other header becomes a value column. Each file is read by its own
    header and the files are matched by name: a column that some file lacks is missing on its rows."""
    out = None
    for one in [path] if isinstance(path, str) else path:
        names = header_of(spark, one, sep)
        lacking = [c for c in id_types if c not in names]
        if lacking:
            raise ValueError(f"{one} has no column {lacking}")
        fields = [T.StructField(name, T._parse_datatype_string(id_types.get(name, value_type))) for name in names]
        reader = spark.read.option("header", True).option("enforceSchema", False).option("sep", sep)
        rows = reader.schema(T.StructType(fields)).csv(one)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_years(spark: SparkSession, paths: Sequence[str], schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """Yearly files stacked in one scan; the year is read from the file name. A file whose header is not the schema's fails."""
    df = spark.read.option("header", True).option("enforceSchema", False).option("sep", sep).schema(schema).csv(list(paths))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    in_name = F.regexp_extract(name, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    in_folder = F.regexp_extract(folder, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    return df.select("*", F.coalesce(in_name.try_cast("int"), in_folder.try_cast("int")).alias("year"))


def read_report_matrix(
    df: DataFrame, row_col: str, first: int | None, last: int | None, code_col: str, codes: dict, entities: Sequence[str],
    entity_name: str = "entity",
) -> DataFrame:
    """Report export with one column per entity → one row per entity.

    ``codes`` maps an output column to the row codes whose values it sums (None stands for the
    row without a code). Rows outside ``first..last`` are banner or detail rows.
    """
    rows = df
    if first is not None:
        rows = rows.filter(F.col(row_col) >= first)
    if last is not None:
        rows = rows.filter(F.col(row_col) <= last)
    wanted = {}
    keep = F.lit(False)
    for name, listed in codes.items():
        real = [c for c in listed if c is not None]
        cond = F.col(code_col).isin(*real) if real else F.lit(False)
        if None in listed:
            cond = F.coalesce(cond, F.lit(False)) | F.col(code_col).isNull()
        wanted[name] = cond
        keep = keep | cond
    long = to_long(rows.filter(keep).select(code_col, *[F.col(f"`{e}`").cast("double").alias(e) for e in entities]),
                   [code_col], list(entities), entity_name, "__v")
    return long.groupBy(entity_name).agg(
        *[F.sum(F.when(cond, F.col("__v"))).alias(name) for name, cond in wanted.items()]
    )


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Clean table; a column list reaches the scan."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)
