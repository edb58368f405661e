"""Passages of many words that stand in several places, wherever they begin and end, by winnowing and exact windows.

A window is ``size`` neighbouring words of a text. Of the ``_GRAM``-word strings in a window the one of the smallest hash is its anchor, so equal
windows have equal anchors, and few strings of a text are anchors. Anchors are compared first, then, for anchors that stand in two texts, the runs
of neighbouring windows that share one; single windows only where an anchor has different runs. Contents are told by 128 bits, those of the anchor included, and the earliest
text of each is found like the earliest place of a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialize, small_batches

_GRAM = 16  # words of an anchor, or the whole window if that is shorter
_PART = 1 << 20  # bytes of a text that are split, and words that are hashed, at a time
_KNOWN = 200_000  # words a task remembers; no effect on results
_FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TEXT = ("doc", "mark")


class _Values(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, 42)
        return value


def word_values(text: str, known: _Values) -> np.ndarray:
    """A number for each word of a text: runs without ASCII white space, A-Z lower-cased."""
    data = text.encode("utf-8", "surrogatepass").translate(LOWER).translate(_BLANKS)
    found, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + _PART) if at + _PART < len(data) else len(data)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        if len(known) > _KNOWN:
            known.clear()
        found.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


_BLANKS = bytes(32 if c in b" \t\r\n\x0b\x0c" else c for c in range(256))


def run_hashes(values: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A hash of every ``size`` neighbouring values: a polynomial in ``factor`` modulo 2**64, put together from runs of doubled lengths."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, run, width = None, 0, values, 1
    while True:
        if size & width:
            k = len(values) - done - width + 1
            total = run if total is None else total[:k] * np.uint64(pow(factor, width, 1 << 64)) + run[done : done + k]
            done += width
        if done == size:
            return total
        k = len(run) - width
        run = run[:k] * np.uint64(pow(factor, width, 1 << 64)) + run[width:]
        width *= 2


def _blocks(values: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, values, anchors) of a text's windows, block by block: the place of the first window, the words' values, and each window's anchor as an offset
    from that place."""
    gram = min(_GRAM, size)
    for at in range(0, len(values) - size + 1, _PART):
        part = values[at : at + _PART + size - 1]
        grams = run_hashes(part, gram, _FACTORS[0])
        choice = np.lib.stride_tricks.sliding_window_view(grams, size - gram + 1).argmin(axis=1)
        yield at, part, choice + np.arange(len(choice))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _rows(batch: pa.RecordBatch, rows: list[int], counts: list[int], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Rows of a text's places: doc and mark as often as it has places."""
    of = pa.array(np.repeat(np.array(rows, np.int64), np.array(counts, np.int64)))
    return pa.RecordBatch.from_pydict({"doc": batch.column("doc").take(of), "mark": batch.column("mark").take(of), **columns})


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _anchors(plain: DataFrame, size: int) -> DataFrame:
    """(doc, mark, at, anchor): the anchors of all texts' windows."""
    kind, gram = plain.schema["doc"].dataType.simpleString(), min(_GRAM, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Values()
        for batch in small_batches(batches, "t"):
            rows, counts, places, hashes = [], [], [], []
            for i, t in enumerate(batch.column("t")):
                for at, part, anchors in _blocks(word_values(t.as_py() or "", known), size):
                    chosen = np.unique(anchors)
                    rows.append(i), counts.append(len(chosen))
                    places.append((at + chosen).astype(np.int32)), hashes.append(run_hashes(part, gram, _FACTORS[0])[chosen])
            yield _rows(batch, rows, counts, {"at": pa.array(_joined(places, np.int32)), "anchor": _long(_joined(hashes, np.uint64))})

    return plain.mapInArrow(run, f"doc {kind}, mark long, at int, anchor long")


def _runs(texts: DataFrame, size: int) -> DataFrame:
    """(doc, mark, at, n, anchor, digests): neighbouring windows of one anchor, for the anchors that are one of ``anchors``; place of the first, their number and
    each one's digest."""
    kind = texts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Values()
        for batch in small_batches(batches, "t"):
            rows, counts, places, lengths, hashes, digests = [], [], [], [], [], []
            for i, (t, wanted) in enumerate(zip(batch.column("t"), batch.column("anchors"))):
                wanted = wanted.values.to_numpy()
                for at, part, anchors in _blocks(word_values(t.as_py() or "", known), size):
                    is_wanted = np.zeros(len(part), bool)
                    here = wanted - at
                    is_wanted[here[(here >= 0) & (here < len(part))]] = True
                    chosen = np.flatnonzero(is_wanted[anchors])
                    of, begin, n = np.unique(anchors[chosen], return_index=True, return_counts=True)
                    rows.append(i), counts.append(len(of)), places.append((at + chosen[begin]).astype(np.int32)), lengths.append(n.astype(np.int32))
                    hashes.append(run_hashes(part, min(_GRAM, size), _FACTORS[0])[of]), digests.append(run_hashes(part, size, _FACTORS[1])[chosen])
            n = _joined(lengths, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), _long(_joined(digests, np.uint64)))
            yield _rows(batch, rows, counts, {"at": pa.array(_joined(places, np.int32)), "n": pa.array(n), "anchor": _long(_joined(hashes, np.uint64)), "digests": lists})

    return texts.mapInArrow(run, f"doc {kind}, mark long, at int, n int, anchor long, digests array<long>")


def repeats(rows: DataFrame, keys: list[str], label: str, of: tuple[str, ...] = ("doc", "mark", "at")) -> DataFrame:
    """(keys, first): the contents that stand in several places, told by ``of``, and the smallest place, null ids first; written, so that the join back has
    plain inputs whose hot keys can be split."""
    place = F.struct(*of)
    ends = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return materialize(ends.where(~F.col("first").eqNullSafe(F.col("last"))).select(*keys, "first"), label)


def is_first(of: tuple[str, ...] = ("doc", "mark", "at")) -> Column:
    """True at the smallest place."""
    return F.struct(*of).eqNullSafe(F.col("first"))


def shared_windows(plain: DataFrame, size: int) -> DataFrame:
    """(doc, mark, at, n, first): the windows of ``plain`` (doc, mark, t) that stand in another text too, as ``n`` neighbouring ones from the number of the first
    one's first word; ``first`` is false where an earlier text has them. Rows may overlap; a window is in an earlier text if any row says so.

    Texts go by (doc, mark); ``mark`` tells apart texts that share an id, and rows that agree in both are one text. What a text repeats of itself alone is not told. Null texts and those of fewer than ``size`` words have no window.

    Equal windows have equal anchors, so runs of windows of one anchor are compared first. All windows of a run that an earlier text has are settled. Windows are compared
    one by one only where an anchor has different runs, and there in the earliest text of each run."""
    anchors = materialize(_anchors(plain, size), "anchors")
    again = anchors.join(repeats(anchors, ["anchor"], "repeated-anchors", _TEXT), "anchor")
    shared = materialize(again.groupBy("doc", "mark").agg(F.collect_set("at").alias("anchors")), "shared-anchors")
    shared = shared.select(F.col("doc").alias("of_doc"), F.col("mark").alias("of_mark"), "anchors")
    same = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("mark") == F.col("of_mark"))
    texts = plain.join(shared, same).select("doc", "mark", "t", "anchors")
    runs = materialize(_runs(texts, size).withColumn("run", F.xxhash64("digests")), "runs")

    place, several = F.struct(*_TEXT), ~F.col("first").eqNullSafe(F.col("last"))
    ends = runs.groupBy("anchor", "run").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    known = materialize(ends.select("anchor", "run", "first", several.alias("again")), "distinct-runs")
    whole = runs.drop("digests").join(known, ["anchor", "run"]).withColumn("is_first", is_first(_TEXT)).where(~F.col("is_first") | F.col("again"))

    unlike = known.groupBy("anchor").agg(F.min("run").alias("least"), F.max("run").alias("most")).where("least <> most").select("anchor")
    open_runs = materialize(known.join(materialize(unlike, "unlike-anchors"), "anchor"), "open-runs")  # an anchor of a common passage has a run for each text around it
    windows = runs.join(open_runs, ["anchor", "run"]).where(is_first(_TEXT)).select("doc", "mark", "at", "anchor", "again", F.posexplode("digests").alias("k", "digest"))
    windows = materialize(windows.withColumn("at", F.col("at") + F.col("k")).drop("k"), "windows")
    ends = windows.groupBy("anchor", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.bool_or("again").alias("again"))
    found = materialize(ends.where(several | F.col("again")).select("anchor", "digest", "first"), "repeated-windows")
    single = windows.join(found, ["anchor", "digest"]).select("doc", "mark", "at", F.lit(1).alias("n"), is_first(_TEXT).alias("first"))
    return whole.select("doc", "mark", "at", "n", F.col("is_first").alias("first")).unionByName(single)
