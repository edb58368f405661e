"""Exact top-k search by MaxScore over integer vectors.

Every (dimension, sign) is a term: its postings are the rows whose component has that sign. The rows are dealt into shards, the queries into
blocks; each pair of a shard and a block is one task's group. A query's terms are ordered by the most they can add to a score
in the shard. With the k-th best score known so far as the threshold, the terms whose bounds together stay below it are
non-essential: a row that is in no essential term's postings cannot reach the threshold. The essential postings are traversed, the other
terms are probed only for rows that still can reach it. The shards' best rows are merged by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD_ROWS, BLOCK_QUERIES = 4096, 1024
_PROBE = 8


class Shard:
    """Postings of one shard: components by term, and each term's extremes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], np.ascontiguousarray(vectors[order].T)
        self.high, self.low = self.v.max(axis=1), self.v.min(axis=1)
        self.plus, self.minus = self.v > 0, self.v < 0

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows other than ``own``; ties to the smaller id."""
        bound = np.maximum(np.maximum(query * self.high, query * self.low), 0)
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [0]))
        other = self.ids != own
        threshold = self._seed(query, order[:_PROBE], other, k)
        essential = int(np.argmax(rest < threshold)) if (rest < threshold).any() else len(order)
        lists = [self.plus[t] if query[t] > 0 else self.minus[t] for t in order[:essential] if query[t]]
        # below a threshold of zero or less, rows that no term lists may still be among the best
        alive = other & np.logical_or.reduce(lists) if lists and threshold > 0 else other
        rows = np.flatnonzero(alive)
        terms = order[:essential]
        score = query[terms] @ self.v[terms][:, rows]
        at = essential
        while True:
            keep = score + rest[at] >= threshold
            if not keep.all():
                rows, score = rows[keep], score[keep]
            if at >= len(order) or not len(rows):
                break
            terms = order[at : at + _PROBE]
            score = score + query[terms] @ self.v[np.ix_(terms, rows)]
            at += len(terms)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]

    def _seed(self, query: np.ndarray, terms: np.ndarray, other: np.ndarray, k: int) -> float:
        """The k-th best score among rows that look good by a few terms: a threshold the result cannot fall below."""
        if other.sum() < k:
            return -math.inf
        partial = np.where(other, query[terms] @ self.v[terms], -math.inf)
        n = min(4 * k, int(other.sum()))
        some = np.argpartition(-partial, n - 1)[:n]
        return float(np.sort(query @ self.v[:, some])[-k])


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def _usable(vector: Column) -> Column:
    limit = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < limit))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256,
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows by integer inner product for each row where ``is_query`` holds.

    Components become floor(scale * x). A query's own row is no candidate; ties go to the smaller id. Rows whose id or vector is
    null, or whose vector has a null or non-finite component, take no part; shorter vectors count as padded with zeros. Rows that share
    an id are one row, with the least of their vectors. Fewer candidates than k: all of them. No rows or no queries:
    an empty result. Scores are exact below 2**53.
    """
    plain = rows.where(F.col(vec_id).isNotNull() & _usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("id"), whole_components(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    table = materialize(plain.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")), "vectors")
    size = table.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    shards, blocks = max(1, -(-size["n"] // shard_rows)), max(1, -(-size["q"] // block_queries))
    of_shard = F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")
    of_block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    left = table.select("id", "v", of_shard, F.explode(_numbers(blocks)).alias("block"))
    right = table.where("q").select("id", "v", of_block, F.explode(_numbers(shards)).alias("shard"))

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        column = column.combine_chunks()
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(sizes) and (sizes == width).all():
            return flat.reshape(-1, width)
        out, at = np.zeros((len(sizes), width)), 0
        for i, n in enumerate(sizes):
            out[i, :n], at = flat[at : at + n], at + n
        return out

    def search(these: pa.Table, queries: pa.Table) -> pa.Table:
        out = {c: [] for c in ("query_id", "vec_id", "score")}
        if these.num_rows and queries.num_rows:
            width = max(max(t.column("v").combine_chunks().value_lengths().to_pylist()) for t in (these, queries))
            shard = Shard(these.column("id").to_numpy(), matrix(these.column("v"), width))
            for own, q in zip(queries.column("id").to_pylist(), matrix(queries.column("v"), width)):
                ids, scores = shard.top(q, own, k)
                out["query_id"].append(np.full(len(ids), own, np.int64))
                out["vec_id"].append(ids)
                out["score"].append(scores.astype(np.int64))
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in out.items()})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
