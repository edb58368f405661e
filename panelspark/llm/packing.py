"""Packing into optimal length buckets.

Documents are cut into pieces of at most ``context`` tokens. The global histogram of piece lengths (``context`` counts at most)
goes to the driver, where dynamic programming chooses the bucket bounds with the least padding in total. Inside each bucket,
pieces in order of their keys form batches of as many rows as the token budget holds. Places within a bucket are counted
per range of a written, sorted table, so that a bucket of any size is spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .tokens import encoder


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges over ascending ``lengths`` with the least sum of padding; of equal
    choices the one with fewer ranges, then with smaller bounds from the right."""
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    tokens = np.concatenate(([0], np.cumsum(counts.astype(np.int64) * lengths)))
    big = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, big, np.int64)
    best[0] = 0
    choice, totals = [], []
    for _ in range(min(buckets, n)):
        new, back = np.full(n + 1, big, np.int64), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            new[j], back[j] = cost[i], i
        choice.append(back)
        totals.append(new[n])
        best = new
    k = int(np.argmin(totals))
    bounds, j = [], n
    while k >= 0:
        bounds.append(int(lengths[j - 1]))
        j = int(choice[k][j])
        k -= 1
    return bounds[::-1]


def token_lengths(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_tokens: int = 1) -> DataFrame:
    """(key, n_tokens) of every row: the ids of the whole text and ``end_tokens`` more; a null text has the latter only."""
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))

    def run(batches):
        encode = encoder(tokenizer)
        for batch in small_batches(batches, "t"):
            lengths = encode.lengths(batch.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lengths + end_tokens, pa.int64())], names=["key", "n_tokens"])

    return plain.mapInArrow(run, f"key {plain.schema['key'].dataType.simpleString()}, n_tokens long")


def _bucket(bounds: list[int], length: Column) -> Column:
    """Number of the first bound that is not below a length."""
    found = F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(bounds))):
        found = F.when(length <= b, F.lit(i)).otherwise(found)
    return found


def pack_lengths(docs: DataFrame, key: str, n_tokens: str, context: int = 2048, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket, bucket_len, batch, slot, padding) for every piece of every document.

    ``start`` is the piece's first token in its document, ``bucket_len`` the length it is padded to, ``batch`` counts from 0 in
    each bucket, ``slot`` from 0 in each batch; a batch has budget // bucket_len rows (its bucket's last may have
    fewer), so never more than ``budget`` tokens. Documents of more than ``context`` tokens are cut into pieces of ``context`` and a rest. Documents with
    a null or no length have no piece. Rows with null or repeated keys are packed like others, with ties in no fixed
    order but each once. An empty table gives an empty result.
    """
    if budget < context:
        raise ValueError("the budget must hold one piece of full length")
    whole = docs.select(F.col(key).alias("doc_id"), F.col(n_tokens).cast("long").alias("all")).where(F.col("all") > 0)
    starts = F.posexplode(F.expr(f"sequence(0L, all - 1, {context}L)")).alias("piece", "start")
    pieces = whole.select("doc_id", "all", starts).select(
        "doc_id", "piece", "start", F.least(F.lit(context).cast("long"), F.col("all") - F.col("start")).alias("n_tokens")
    )
    histogram = pieces.groupBy("n_tokens").count().collect()  # `context` rows at most
    histogram.sort(key=lambda r: r["n_tokens"])
    lengths = np.array([r["n_tokens"] for r in histogram], np.int64)
    bounds = best_bounds(lengths, np.array([r["count"] for r in histogram], np.int64), buckets)

    order = ["bucket", "doc_id", "piece"]
    placed = pieces.withColumn("bucket", _bucket(bounds, F.col("n_tokens"))).repartitionByRange(*order).sortWithinPartitions(*order)
    id_bits = F.monotonically_increasing_id()
    placed = placed.select("*", F.shiftright(id_bits, 33).alias("part"), id_bits.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    placed = materialize(placed, "ordered")
    # one row per part and bucket in it: fewer than parts + buckets
    spans = placed.groupBy("bucket", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    before, rows = {}, []
    for r in sorted(spans, key=lambda r: (r["bucket"], r["part"])):
        rows.append((r["bucket"], r["part"], before.get(r["bucket"], 0) - r["first"]))
        before[r["bucket"]] = before.get(r["bucket"], 0) + r["n"]
    shift = placed.sparkSession.createDataFrame(rows, "bucket int, part long, shift long")
    upper = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds] or [F.lit(0).cast("long")]), F.col("bucket") + 1)
    size = F.floor(F.lit(budget) / F.col("bucket_len"))
    return (
        placed.join(F.broadcast(shift), ["bucket", "part"])  # fewer rows than parts + buckets
        .withColumn("bucket_len", upper)
        .withColumn("place", F.col("at") + F.col("shift"))
        .select(
            "doc_id",
            "piece",
            "start",
            "n_tokens",
            "bucket",
            "bucket_len",
            F.floor(F.col("place") / size).cast("long").alias("batch"),
            (F.col("place") % size).cast("int").alias("slot"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``pack_lengths`` over the token lengths of whole texts (with an end token each)."""
    lengths = materialize(token_lengths(docs, tokenizer, key, text), "lengths")
    return pack_lengths(lengths, "key", "n_tokens", **how)
