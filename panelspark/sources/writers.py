"""Clean-table writes, model store and table export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COEFFICIENT_SCHEMA = (
    "store string, position int, model_id string, term string, role string, term_order int, estimate double, "
    "std_error double, statistic double, p_value double"
)
MODEL_SCHEMA = (
    "store string, position int, model_id string, estimator string, vce string, n long, k int, df double, "
    "r2 double, adj_r2 double, rmse double, n_clusters long"
)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


class ModelStore:
    """Saved estimates: appended in order under a store name, read back by position."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def save(self, store: str, results: Sequence) -> None:
        """Replace the store with the results, numbered from 1."""
        self._write(store, results, 1, "overwrite")

    def append(self, store: str, results: Sequence) -> None:
        """Add the results after the store's last one; a new store begins at 1."""
        self._write(store, results, 1 + self._size(store), "append")

    def _size(self, store: str) -> int:
        try:
            return self.models(store).agg(F.max("position")).first()[0] or 0
        except AnalysisException:  # nothing was stored yet
            return 0

    def _write(self, store: str, results: Sequence, first: int, mode: str) -> None:
        coefs, models = [], []
        for position, r in enumerate(results, start=first):
            coefs += [(store, position, *row) for row in r.coefficient_rows()]
            models.append((store, position, *r.model_row()))
        for part, rows, schema in (("coefficients", coefs, COEFFICIENT_SCHEMA), ("models", models, MODEL_SCHEMA)):
            df = self.spark.createDataFrame(rows, schema).coalesce(1)
            df.drop("store").write.mode(mode).parquet(f"{self.path}/{part}/store={store}")

    def coefficients(self, store: str, position: int | None = None) -> DataFrame:
        return self._read("coefficients", COEFFICIENT_SCHEMA, store, position)

    def models(self, store: str, position: int | None = None) -> DataFrame:
        return self._read("models", MODEL_SCHEMA, store, position)

    def _read(self, part: str, schema: str, store: str, position: int | None) -> DataFrame:
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{part}").filter(F.col("store") == store)
        return df if position is None else df.filter(F.col("position") == position)


def table_rows(table: DataFrame, sep: str = " & ", end: str = " \\\\") -> DataFrame:
    """Each row of a formatted table as one line of text."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns]
    return table.select(F.concat(F.concat_ws(sep, *cells), F.lit(end)).alias("value"))


def export_table(table: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Write a formatted table as text lines. A table has a few dozen rows, so it is one file."""
    ordered = table.orderBy(*order) if order else table
    hidden = [c for c in order if c in table.columns]
    table_rows(ordered.drop(*hidden)).coalesce(1).write.mode("overwrite").text(path)
