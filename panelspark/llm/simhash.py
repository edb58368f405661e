"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within ``radius`` bits of each other are found with certainty: every bit position gets
a nonzero vector of radius + 1 bits, and table v keeps the positions whose vector has odd overlap
with v. The vectors of at most ``radius`` differing positions span a proper subspace, so some v is
orthogonal to all of them: that table masks every differing bit and the two fingerprints share a bucket.

Buckets are sorted runs of a range partitioning on (table, masked value, fingerprint), so a large bucket
spreads over tasks. A run that lies inside one task and has at most ``BLOCK`` members is compared there, and one at a
task's edge in a second step. Larger buckets are covered once more: their members differ only in the bits that the
table masks, so the same construction over those bits splits them without losing a pair. As fingerprints are
distinct, what is left of a bucket has no more members than its last free bits have values; it is compared
block against block. Only a spanning forest of the links leaves a task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fresh, materialize, small_batches
from .components import connected_components

BLOCK = 1024
_CHUNK = 1 << 15
_GOLDEN = 0x9E3779B97F4A7C15
_ODD = 0xBF58476D1CE4E5B9
_WRAP = (1 << 64) - 1


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``shingle`` words, repeats included; fewer words: of the whole
    sequence; no word: none. Words are runs of bytes other than ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), "<u8", len(words) - shingle + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits as a signed long: bit i is set if it is set in over half of the hashes. None: zero."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[i : i + _CHUNK])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def _remixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n-th of several independent hash sets; the first is the plain one."""
    if n == 0:
        return hashes
    with np.errstate(over="ignore"):
        mixed = (hashes + np.uint64(n * _GOLDEN & _WRAP)) * np.uint64(_ODD)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_GOLDEN)
    return mixed ^ (mixed >> np.uint64(32))


def with_fingerprints(docs: DataFrame, text: str, keep: Sequence[str], shingle: int, words: int) -> DataFrame:
    """``keep`` columns (as k0, k1, ...) plus fp0, fp1, ...: one independent fingerprint each."""
    plain = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema[:-1]] + [f"fp{i} long" for i in range(words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            found: list[list[int]] = [[] for _ in range(words)]
            for t in batch.column(len(keep)):
                h = shingle_hashes(t.as_py(), shingle)
                for i in range(words):
                    found[i].append(fingerprint(_remixed(h, i)))
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(f, pa.int64()) for f in found]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"k{i}" for i in range(len(keep))] + [f"fp{i}" for i in range(words)])

    return plain.mapInArrow(run, schema)


def covering_masks(radius: int) -> list[int]:
    """2**(radius+1) - 1 signed 64-bit masks; any two values that differ in at most ``radius`` bits agree under one."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def refining_masks(radius: int) -> list[list[int]]:
    """For each covering mask, masks that keep its bits and cover the rest: values that agree under it and differ in at most
    ``radius`` bits agree under one of its refinements."""
    out, size = [], 2 ** (radius + 1)
    for mask in covering_masks(radius):
        free = [i for i in range(64) if not mask >> i & 1]
        vectors = {b: 1 + n % (size - 1) for n, b in enumerate(free)}
        finer = [(mask & (1 << 64) - 1) | sum(1 << b for b, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, size)]
        out.append([m - (1 << 64) if m >> 63 else m for m in finer])
    return out


def forest(fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each class of nodes whose fingerprints hang together within ``radius``: links to its first node."""
    n = len(fp)
    bits = fp.view(np.uint64)
    near = np.empty((n, n), bool)
    for i in range(0, n, 256):
        near[i : i + 256] = np.bitwise_count(bits[i : i + 256, None] ^ bits[None, :]) <= radius
    return spanning(near, node)


def spanning(near: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each class of nodes that hang together by ``near``: links to its first node."""
    n = len(near)
    label = np.arange(n)
    while True:
        least = np.concatenate([np.where(near[i : i + 256], label[None, :], n).min(axis=1) for i in range(0, n, 256)])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(n))
    return node[moved], node[label[moved]]


_STEP = "kind int, tab int, key long, part int, block int, fp long, node long, other long"
_NAMES = [x.split()[0] for x in _STEP.split(", ")]


def _rows(**columns) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values() if isinstance(v, np.ndarray))
    kinds = {"kind": np.int32, "tab": np.int32, "part": np.int32, "block": np.int32}
    full = [np.broadcast_to(np.asarray(columns.get(c, 0), dtype=kinds.get(c, np.int64)), n) for c in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in full], names=_NAMES)


def _within_task(radius: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        part = TaskContext.get().partitionId()
        t = pa.Table.from_batches(got)
        tab, key, fp, node = (t.column(c).to_numpy() for c in ("tab", "key", "fp", "node"))
        starts = np.concatenate(([0], np.flatnonzero((tab[1:] != tab[:-1]) | (key[1:] != key[:-1])) + 1))
        sizes = np.diff(np.append(starts, len(tab)))
        is_open = sizes > block
        is_open[[0, -1]] = True
        two = starts[(sizes == 2) & ~is_open]
        near = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius]
        near = near[node[near] != node[near + 1]]
        if len(near):
            yield _rows(kind=0, node=node[near], other=node[near + 1])
        for a, n in zip(starts[(sizes > 2) & ~is_open], sizes[(sizes > 2) & ~is_open]):
            left, right = forest(fp[a : a + n], node[a : a + n], radius)
            if len(left):
                yield _rows(kind=0, node=left, other=right)
        for a, n in zip(starts[is_open], sizes[is_open]):
            s = slice(a, a + n)
            yield _rows(kind=1, tab=tab[s], key=key[s], part=part, block=np.arange(n) // block, fp=fp[s], node=node[s])

    return run


def _masked(rows: DataFrame, masks: Sequence[int], first: int) -> DataFrame:
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("at", "key")
    return rows.select("fp", "node", keys).select((F.col("at") + first).alias("tab"), "key", "fp", "node")


def _buckets(rows: DataFrame, radius: int, block: int) -> DataFrame:
    """One pass over bucket rows: links found inside tasks (kind 0), members of open buckets (kind 1)."""
    order = ["tab", "key", "fp", "node"]
    ranged = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(_within_task(radius, block), _STEP), "buckets")


def _across(members: DataFrame, radius: int) -> DataFrame:
    """Links inside open buckets, block against block."""
    blocks = members.groupBy("tab", "key").agg(F.collect_set(F.struct("part", "block")).alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = (
        blocks.select("tab", "key", F.explode("blocks").alias("p"), "blocks")
        .select("tab", "key", "p", F.explode("blocks").alias("q"))
        .where("p <= q")
    )
    sides = F.explode(F.when(F.col("p") == F.col("q"), F.array("p")).otherwise(F.array("p", "q")))
    wanted = pairs.select("tab", "key", "p", "q", sides.alias("s")).select("tab", "key", "p", "q", "s.part", "s.block")

    def compare(group: pa.Table) -> pa.Table:
        left, right = forest(group.column("fp").to_numpy(), group.column("node").to_numpy(), radius)
        return pa.table({"node": pa.array(left, pa.int64()), "other": pa.array(right, pa.int64())})

    return (
        wanted.join(members, ["tab", "key", "part", "block"])
        .select("tab", "key", "p", "q", "fp", "node")
        .groupBy("tab", "key", "p", "q")
        .applyInArrow(compare, "node long, other long")
    )


def hamming_links(fps: DataFrame, words: int, radius: int, block: int = BLOCK) -> DataFrame:
    """(node, other): links that join exactly the fp0 values whose rows hang together by some word's
    fingerprints at ``radius`` or fewer differing bits.

    ``fps``: distinct rows of fp0 ... fp<words-1>; a row's node is its fp0 (equal fp0 are linked anyway). Nodes with
    one fingerprint in another word are linked to the least of them, which stands for them in that word's buckets.
    """
    masks, finer = covering_masks(radius), refining_masks(radius)
    links = rows = None
    for w in range(words):
        word = fps.select("fp0").distinct().select(F.col("fp0").alias("fp"), F.col("fp0").alias("node")) if w == 0 else None
        if word is None:
            pairs = fps.select(F.col(f"fp{w}").alias("fp"), F.col("fp0").alias("node"))
            word = materialize(pairs.groupBy("fp").agg(F.min("node").alias("node")), "word")
            same = pairs.join(word.select("fp", F.col("node").alias("other")), "fp").where("node <> other").select("node", "other")
            links = same if links is None else links.unionByName(same)
        one = _masked(word, masks, w * len(masks))
        rows = one if rows is None else rows.unionByName(one)
    step = _buckets(rows, radius, block)
    inside = step.where("kind = 0").select("node", "other")
    links = inside if links is None else links.unionByName(inside)

    members = step.where("kind = 1").drop("kind", "other")
    sizes = materialize(members.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    sized = members.join(sizes, ["tab", "key"])
    links = links.unionByName(_across(sized.where(F.col("n") <= block).drop("n"), radius))
    if sizes.where(F.col("n") > block).isEmpty():
        return links
    table = F.array(*[F.array(*[F.lit(m) for m in each]) for each in finer])
    large = sized.where(F.col("n") > block).select("tab", "fp", "node", F.posexplode(F.get(table, F.col("tab") % len(masks))).alias("at", "mask"))
    again = large.select((F.col("tab") * len(masks) + F.col("at")).alias("tab"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node")
    step = _buckets(again, radius, block)
    links = links.unionByName(step.where("kind = 0").select("node", "other"))
    return links.unionByName(_across(step.where("kind = 1").drop("kind", "other"), radius))


def _classes(docs: DataFrame, keys: list[str], text: str, shingle: int, radius: int, words: int) -> DataFrame:
    """k0, k1, ... (the keys), fp0 and root (the class, as its smallest fp0) of every row."""
    marked = materialize(with_fingerprints(docs, text, keys, shingle, words), "fingerprints")
    names = [f"fp{i}" for i in range(words)]
    distinct = materialize(marked.select(*names).distinct(), "classes")
    roots = connected_components(hamming_links(distinct, words, radius))
    nodes = distinct.select(F.col("fp0").alias("node")).distinct()
    of_node = nodes.join(roots, "node", "left").select(F.col("node").alias("fp0"), F.coalesce("root", "node").alias("root"))
    return marked.join(materialize(of_node, "roots"), "fp0")


def simhash_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 4, words: int = 4
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Two rows are linked if one of their ``words`` independent fingerprints differs in at most ``radius`` bits; a
    component is what hangs together by links. ``component_id`` is the smallest doc_id in it, ``fingerprint`` the
    first fingerprint in 16 hex digits. Null, empty and blank texts have fingerprints of zero and are linked like
    others. Rows with a null doc_id take part; a component in which all ids are null has a null component_id.
    Repeated rows are answered once each. Very long texts are hashed whole. An empty table gives an empty result.
    """
    rows = materialize(_classes(docs, [doc_id], text, shingle, radius, words), "rows")
    ids = materialize(rows.groupBy("root").agg(F.min("k0").alias("component_id")), "ids")
    return rows.join(ids, "root").select(
        F.col("k0").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component of ``simhash_classes``: the smallest doc_id's (null ids last, then by a hash of the text).

    Rows are linked if their fingerprints over ``shingle``-word runs differ in at most ``radius`` bits. Null, empty and blank texts have one fingerprint, so one
    of them stays; rows that repeat its id and text are cut to one. Very long texts are hashed whole. All columns stay as they are, whatever
    their names; an empty table gives an empty result.
    """
    mark = fresh(docs, "text_mark")
    marked = docs.withColumn(mark, F.xxhash64(F.col(text).cast("string")))
    rows = materialize(_classes(marked, [doc_id, mark], text, shingle, radius, 1), "rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("k0").isNull().alias("late"), "k0", "k1")).alias("first"))
    left, right = fresh(marked, "kept_id"), fresh(marked, "kept_mark")
    kept = materialize(first.select(F.col("first.k0").alias(left), F.col("first.k1").alias(right)), "kept")
    same = F.col(doc_id).eqNullSafe(F.col(left)) & (F.col(mark) == F.col(right))
    return marked.join(kept, same, "left_semi").dropDuplicates([doc_id, mark]).drop(mark)
