"""Helpers the operators of this folder share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import materialize, shared_folder  # noqa: F401  (materialize is used by the operators)

# Byte table that lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on the machine that asks: the installed package, else the
    folder given by PUBLIC_TOKENIZERS."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZERS, name)
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col: str, mod: int) -> Column:
    """crc32 of a column's decimal text modulo ``mod``; null for null."""
    return F.crc32(F.col(col).cast("string")) % F.lit(mod)


def held_out(col: str, mod: int, rest: int) -> Column:
    """True where the row's remainder is ``rest``; rows without a key are not held out (and have no label)."""
    return F.coalesce(remainder(col, mod) == rest, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(batches: Iterable[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in runs of about ``size`` bytes of one text column (a longer text is a run of its own), so
    that only few texts are Python strings at a time."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(a, b - a)
            a = b
