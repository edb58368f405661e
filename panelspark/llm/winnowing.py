"""Benchmark decontamination by winnowing.

Of every ``window`` words in a row, texts keep the smallest hash of their k-grams. Any run of ``window`` words that a
document shares with an item therefore leaves the same kept k-gram on both sides. Kept k-grams are joined, each with the words
around it, and every match is extended word by word; runs of at least ``window`` words are hits. Items of fewer
words are matched whole: there k is the item's length and every position is kept.

Documents' k-grams that no item has are dropped before the join by a Bloom filter of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

# Bytes that are no part of a word (all ASCII but digits and letters) become blanks; A-Z are lower-cased.
_WORD_BYTES = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xBF58476D1CE4E5B9)
FILTER_BITS = 1 << 26  # 8 MB, whatever the benchmark's size
_PART = "part int, bits binary"


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc = (acc ^ words[i : i + n]) * _GOLDEN
            acc ^= acc >> np.uint64(32)
        acc = acc * _ODD
    return acc ^ (acc >> np.uint64(31))


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the rightmost smallest hash in every run of ``width`` k-grams."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for i in range(1, width):
        less = grams[i : i + n] <= best
        best[less] = grams[i : i + n][less]
        at[less] = np.flatnonzero(less) + i
    return np.unique(at)


def _kept(words: np.ndarray, k: int, window: int, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length of the shared run asked for, positions, hashes) for the winnowed route and each short length."""
    grams = gram_hashes(words, k)
    at = winnow(grams, window - k + 1)
    yield window, at, grams[at]
    for m in short:
        grams = gram_hashes(words, m)
        yield m, np.arange(len(grams)), grams


def _around(words: np.ndarray, at: int, k: int, reach: int) -> tuple[int, bytes]:
    a = max(0, at - reach)
    return a, words[a : at + k + reach].tobytes()


def _slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        for i in range(3):
            yield ((hashes * np.uint64(2 * i + 1)) >> np.uint64(7 + 9 * i)) % np.uint64(FILTER_BITS)


def _filter(marks: DataFrame) -> np.ndarray:
    """Bit table of all items' kept k-grams: one table of fixed size per task, joined by or, in two rounds."""

    def build(batches):
        table = None
        for batch in batches:
            table = np.zeros(FILTER_BITS, bool) if table is None else table
            for s in _slots(batch.column(0).to_numpy().view(np.uint64)):
                table[s] = True
        if table is not None:
            packed = np.packbits(table)
            step = 1 << 20
            for i in range(0, len(packed), step):
                if packed[i : i + step].any():
                    yield pa.RecordBatch.from_pydict({"part": pa.array([i // step], pa.int32()), "bits": pa.array([packed[i : i + step].tobytes()])})

    def merge(table: pa.Table) -> pa.Table:
        bits = np.zeros(0, np.uint8)
        for b in table.column("bits"):
            one = np.frombuffer(b.as_py(), np.uint8)
            bits = bits | one if len(bits) else one
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([bits.tobytes()])})

    rows = marks.select("fp").mapInArrow(build, _PART).groupBy("part").applyInArrow(merge, _PART).collect()
    packed = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        packed[r["part"] << 20 : (r["part"] << 20) + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return packed


def _maybe(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for s in _slots(hashes):
        ok &= (packed[(s >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (s & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
    return ok


_MARK = "n int, fp long, at int, start int, around binary"


def _mark_rows(words: np.ndarray, k: int, window: int, short: list[int], packed: np.ndarray | None) -> list[dict]:
    rows = []
    for n, at, hashes in _kept(words, k, window, short):
        if packed is not None and len(at):
            ok = _maybe(packed, hashes)
            at, hashes = at[ok], hashes[ok]
        inner = k if n == window else n
        for p, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
            start, around = _around(words, p, inner, window - k if n == window else 0)
            rows.append({"n": n, "fp": h, "at": p, "start": start, "around": around})
    return rows


_MARKS_TYPE = pa.list_(pa.struct([("n", pa.int32()), ("fp", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("around", pa.binary())]))


def _marked(df: DataFrame, key: str, text: str, k: int, window: int, short: list[int] | None, packed) -> DataFrame:
    """(key, n_words, marks) of every row; ``short`` None: the row's own length, if it is under ``window``."""
    plain = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    shared = None if packed is None else df.sparkSession.sparkContext.broadcast(packed)  # FILTER_BITS bits at most

    def run(batches):
        bits = None if shared is None else shared.value
        for batch in small_batches(batches, "t"):
            counts, marks = [], []
            for t in batch.column("t"):
                words = word_hashes(t.as_py())
                counts.append(len(words))
                if short is None:
                    own = [len(words)] if 0 < len(words) < window else []
                    marks.append(_mark_rows(words, k, window, own, bits))
                else:
                    marks.append(_mark_rows(words, k, window, short, bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts, pa.int64()), pa.array(marks, _MARKS_TYPE)], names=["key", "n_words", "marks"]
            )

    kind = plain.schema["key"].dataType.simpleString()
    return plain.mapInArrow(run, f"key {kind}, n_words long, marks array<struct<n:int,fp:long,at:int,start:int,around:binary>>")


def _extend(n: int, k: int, at: int, start: int, around: bytes, item_at: int, item_start: int, item_around: bytes) -> tuple[int, int] | None:
    """The run of equal words about a matching k-gram, if it has at least n words and the k-grams are equal."""
    a, b = np.frombuffer(around, np.uint64), np.frombuffer(item_around, np.uint64)
    i, j = at - start, item_at - item_start
    if not (a[i : i + k] == b[j : j + k]).all():
        return None
    left = 0
    while left < min(i, j) and a[i - left - 1] == b[j - left - 1]:
        left += 1
    right = k
    while right < min(len(a) - i, len(b) - j) and a[i + right] == b[j + right]:
        right += 1
    return (at - left, at + right) if left + right >= n else None


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 5,
    window: int = 10,
) -> DataFrame:
    """(doc_id, n_words, hits, item_ids) for every row of ``docs``.

    ``hits``: disjoint, ordered (start, end) word ranges that lie inside occurrences of an item's windows; ``item_ids``: the items,
    as a sorted list. A window is ``window`` words of an item in a row, or all of a shorter item's. Words are runs of
    ASCII letters (lower-cased), digits and non-ASCII characters. Null and empty texts have no words and no hits; items without
    words hit nothing. Rows are answered one by one, also where ids are null or repeat; a null item_id hits words but is not listed.
    With no items, or only items without words, nothing is hit. An empty ``docs`` gives an empty result.
    """
    item_rows = materialize(_marked(items, item_id, item_text, k, window, None, None), "items")
    tests = item_rows.select(F.col("key").alias("item"), F.explode("marks").alias("m")).select(
        "item", "m.n", "m.fp", F.col("m.at").alias("item_at"), F.col("m.start").alias("item_start"), F.col("m.around").alias("item_around")
    )
    lengths = sorted(r[0] for r in tests.where(F.col("n") < window).select("n").distinct().collect())  # under `window` values
    packed = _filter(tests)

    numbered = _marked(docs, doc_id, text, k, window, lengths, packed).withColumn("row", F.monotonically_increasing_id())
    doc_rows = materialize(numbered, "marks")
    marks = doc_rows.where(F.size("marks") > 0).select("row", F.explode("marks").alias("m")).select("row", "m.*")

    def extend(batches):
        for batch in batches:
            rows, keys, lo, hi = batch.column("row").to_pylist(), batch.column("item"), [], []
            cols = [batch.column(c).to_pylist() for c in ("n", "at", "start", "around", "item_at", "item_start", "item_around")]
            pick = []
            for i, (n, at, start, around, item_at, item_start, item_around) in enumerate(zip(*cols)):
                got = _extend(n, k if n == window else n, at, start, around, item_at, item_start, item_around)
                if got:
                    pick.append(i)
                    lo.append(got[0])
                    hi.append(got[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[i] for i in pick], pa.int64()), keys.take(pa.array(pick, pa.int64())), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                names=["row", "item", "lo", "hi"],
            )

    kind = items.schema[item_id].dataType.simpleString()
    found = marks.join(tests, ["n", "fp"]).drop("fp").mapInArrow(extend, f"row long, item {kind}, lo int, hi int")
    spans = found.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("item_ids")
    )

    def add(acc, x):
        """Lengthen the last range or open the next one; finished ranges wait in ``done``."""
        return F.when(
            x["lo"] <= acc["hi"], F.struct(acc["done"].alias("done"), acc["lo"].alias("lo"), F.greatest(acc["hi"], x["hi"]).alias("hi"))
        ).otherwise(
            F.struct(
                F.concat(acc["done"], F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))).alias("done"), x["lo"].alias("lo"), x["hi"].alias("hi")
            )
        )

    none = F.array().cast("array<struct<lo:int,hi:int>>")
    first = F.col("spans")[0]
    merged = F.aggregate(
        F.slice("spans", 2, F.size("spans")),
        F.struct(none.alias("done"), first["lo"].alias("lo"), first["hi"].alias("hi")),
        add,
        lambda acc: F.concat(acc["done"], F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))),
    )
    spans = spans.select("row", merged.alias("hits"), "item_ids")
    no_items = F.array().cast(f"array<{kind}>")
    return doc_rows.select("row", F.col("key").alias("doc_id"), "n_words").join(spans, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("item_ids", no_items).alias("item_ids")
    ).drop("row")
