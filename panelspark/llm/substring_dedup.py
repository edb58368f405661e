"""Substring deduplication by line or paragraph hashing.

Units are normalised and hashed where the text lies; only digests and places are shuffled. The earliest place of each
repeated digest is found by an aggregate that combines before the shuffle, and written, so that the join back to the
units has plain shuffled inputs whose hot digests can be split. Texts are then cut in one pass over the documents. Passages that begin or end
inside a unit are found by windows of words, see ``passages``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fresh, materialize, small_batches
from .passages import is_first, repeats, shared_windows

RESULTS = ("clean_text", "n_units", "kept_spans", "removed_spans", "passage_words")
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
_BLANKS = re.compile(rb"[ \t\r\n\x0b\x0c]+")
_SPACE = " \t\r\n\x0b\x0c"
_WORDS = re.compile(r"[^ \t\r\n\x0b\x0c]+")


def split_units(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """Start and end (in characters) of each unit; the separators lie between."""
    separator, at = SEPARATORS[unit], 0
    while True:
        end = text.find(separator, at)
        yield at, len(text) if end < 0 else end
        if end < 0:
            return
        at = end + len(separator)


def normalise(unit: str) -> bytes:
    """A-Z lower-cased, runs of ASCII white space one blank, none at the ends."""
    return _BLANKS.sub(b" ", unit.encode("utf-8", "surrogatepass").translate(LOWER)).strip(b" ")


def _units(plain: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(doc, mark, at, digest): the countable units of all texts. ``mark`` tells apart texts that share an id."""
    kind = plain.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in small_batches(batches, "t"):
            rows, at, digests = [], [], []
            for i, t in enumerate(batch.column("t")):
                t = t.as_py()
                if t is None:
                    continue
                for n, (a, b) in enumerate(split_units(t, unit)):
                    norm = normalise(t[a:b])
                    if norm and norm.count(b" ") + 1 >= min_words:
                        rows.append(i)
                        at.append(n)
                        digests.append(hashlib.md5(norm).digest())
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(rows), batch.column("mark").take(rows), pa.array(at, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc", "mark", "at", "digest"],
            )

    return plain.mapInArrow(run, f"doc {kind}, mark long, at int, digest binary")


def longest_passage(words: list[int | None]) -> int:
    """Words of the longest run of repeated units: ``words`` has each unit's number of words, zero for a blank unit (which a run passes over), None for
    one that stands nowhere else."""
    best = run = 0
    for n in words:
        run = 0 if n is None else run + n
        best = max(best, run)
    return best


def word_ends(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (in characters) of each word."""
    ends = np.array([m.span() for m in _WORDS.finditer(text)], np.int64).reshape(-1, 2)
    return ends[:, 0], ends[:, 1]


def covered(words: int, runs: list[dict], size: int) -> np.ndarray:
    """Whether each of a text's words lies in one of the windows of ``size`` words: runs of ``n`` neighbouring windows, the first one beginning at the word ``at``."""
    depth, begin, n = np.zeros(words + 1, np.int64), np.array([x["at"] for x in runs], np.int64), np.array([x["n"] for x in runs], np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, begin + n + size - 1, -1)
    return np.cumsum(depth)[:-1] > 0


def spans_in(a: int, b: int, starts: np.ndarray, ends: np.ndarray, cut: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Kept and removed spans of the unit from a to b: as it is if no word of it is cut, removed whole if all are, else its runs of words."""
    lo, hi = np.searchsorted(starts, (a, b))
    if not cut[lo:hi].any():
        return [(a, b)], []
    if cut[lo:hi].all():
        return [], [(a, b)]
    edges = [lo, *(lo + 1 + np.flatnonzero(np.diff(cut[lo:hi]))), hi]
    runs = [(bool(cut[x]), (int(starts[x]), int(ends[y - 1]))) for x, y in zip(edges, edges[1:])]
    return [r for c, r in runs if not c], [r for c, r in runs if c]


def dedup_units(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = 4, passage: int = 12, window: int | None = None
) -> DataFrame:
    """``docs`` with five more columns: ``clean_text``, ``n_units``, ``kept_spans``, ``removed_spans`` and ``passage_words``.

    Units of at least ``min_words`` words that agree after normalising (ASCII case and white space) are one content; its
    occurrence with the smallest (doc_id, hash of the text, position) stays, null ids first, and every other is removed, inside a document too.
    Spans are (start, end) character offsets in the original text; ``clean_text`` joins the kept units by the separator. A null text stays null, with
    no units; an empty text is one unit that is never removed. ``passage_words`` are the words of the longest run of neighbouring units that also
    stand elsewhere, kept first occurrences included; 0 where it has no more than ``passage`` words. Rows that agree in id and text are one document: they are cut alike. A text
    of which every unit was removed becomes empty; the row stays. Columns of ``docs`` that are named like a result are replaced by it. An empty table gives an empty result.

    ``window`` also removes passages of that many words or more that begin or end anywhere: every word that lies in ``window`` neighbouring words which
    stand in an earlier document too (by doc_id and hash; ASCII case and white space apart, across units). Both rules judge the texts as they came, and every word that goes has a
    copy at a smaller place that stays. What is left of a unit are its runs of kept words, each a span, joined by a blank; a unit without any left is removed.
    ``passage_words`` are then the words that lie in ``window`` neighbouring words which stand in another document too, an earlier or a later one, however few; ``passage``
    has no part in it.
    """
    docs = docs.drop(*RESULTS)
    out = docs.columns
    plain = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("t")).withColumn("mark", F.xxhash64("t"))
    units = materialize(_units(plain, unit, min_words), "units")
    again = units.join(repeats(units, ["digest"], "repeats"), "digest").select("doc", "mark", "at", is_first().alias("kept"))
    of_text = [F.collect_set(F.when(F.col("kept").isNotNull(), F.struct("at", "kept"))).alias("cuts")]
    if window is not None:
        again = again.unionByName(shared_windows(plain, window), allowMissingColumns=True)
        of_text += [F.collect_set(F.when(F.col("first") == is_it, F.struct("at", "n"))).alias(name) for name, is_it in (("later", False), ("first", True))]
    cuts = materialize(again.groupBy("doc", "mark").agg(*of_text), "cuts")

    mark, cut, late, early = (fresh(docs, f"text_{x}") for x in ("mark", "cuts", "later", "first"))
    later, first = (F.lit(None).cast("array<struct<at:int,n:int>>") if window is None else F.col(x) for x in ("later", "first"))
    cuts = cuts.select(
        F.col("doc").alias(fresh(docs, "cut_doc")), F.col("mark").alias(fresh(docs, "cut_mark")), F.col("cuts").alias(cut), later.alias(late), first.alias(early)
    )
    marked = docs.withColumn(mark, F.xxhash64(F.col(text).cast("string")))
    same = F.col(doc_id).eqNullSafe(F.col(cuts.columns[0])) & (F.col(mark) == F.col(cuts.columns[1]))
    joined = marked.join(cuts, same, "left").drop(mark, cuts.columns[0], cuts.columns[1])

    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    separator = SEPARATORS[unit]

    def rebuild(batches):
        for batch in small_batches(batches, text):
            texts, counts, kept, removed, passages = [], [], [], [], []
            for t, c, later, first in zip(batch.column(text), batch.column(cut), batch.column(late), batch.column(early)):
                t, c, later, first = t.as_py(), c.as_py(), later.as_py() or [], first.as_py() or []
                if t is None:
                    texts.append(None), counts.append(0), kept.append([]), removed.append([]), passages.append(0)
                    continue
                repeated = {x["at"]: x["kept"] for x in c or ()}
                stay, gone, words, left, total = [], [], [], [], 0
                starts, ends = word_ends(t) if later or first else (None, None)
                inside = (starts, ends, covered(len(starts), later, window)) if later else None
                for n, (a, b) in enumerate(split_units(t, unit)):
                    total += 1
                    if not repeated.get(n, True):
                        here, lost = [], [(a, b)]
                    else:
                        here, lost = spans_in(a, b, *inside) if inside else ([(a, b)], [])
                    stay += [{"start": x, "end": y} for x, y in here]
                    gone += [{"start": x, "end": y} for x, y in lost]
                    if here:
                        left.append(" ".join(t[x:y] for x, y in here))
                    if repeated and window is None:
                        body = t[a:b].strip(_SPACE)
                        words.append(len(_WORDS.findall(body)) if n in repeated or not body else None)
                if window is not None:
                    passages.append(int(covered(len(starts), later + first, window).sum()) if later or first else 0)
                else:
                    passages.append(n if (n := longest_passage(words)) > passage else 0)
                texts.append(separator.join(left) if gone else t)
                counts.append(total), kept.append(stay), removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in out] + [pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(kept, spans), pa.array(removed, spans), pa.array(passages, pa.int32())],
                names=[*out, *RESULTS],
            )

    schema = docs.schema
    for name, kind in (("clean_text", "string"), ("n_units", "int"), ("kept_spans", "array<struct<start:int,end:int>>"), ("removed_spans", "array<struct<start:int,end:int>>"), ("passage_words", "int")):
        schema = _with(schema, name, kind)
    return joined.select(*[F.col(f"`{x}`") for x in out], F.col(cut), F.col(late), F.col(early)).mapInArrow(rebuild, schema)


def _with(schema, name: str, kind: str):
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
