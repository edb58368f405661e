"""Token ids in a byte-aligned variable-length file format.

Ids are replaced by their rank by frequency over the whole corpus, so that common ids are small. Ranks are coded in blocks: per
rank two bits in a control string tell its length (1 to 4 bytes), and the bytes, low first, stand in a data string of
their own; four ranks share a control byte. A reader looks the four lengths of each control byte up in a table and gathers all bytes of a block with
numpy. A file set is two tables in one folder: ``ranks`` (rank, id) and ``blocks`` (part, block, documents' keys and lengths, control, data), written
by Spark's committer, so a lost executor leaves no half file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import scratch_path

from .common import small_batches
from .tokens import encoder

BLOCK_TOKENS = 1 << 20
# Lengths of the four values of each control byte.
LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, np.uint32)
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    width = 4 if len(v) and code.max() > 1 else 2  # short values need no four bytes each
    data = v.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[np.arange(width, dtype=np.uint8) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of a block."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for i in (1, 2, 3):
        longer = np.flatnonzero(sizes > i)
        if len(longer):
            out[longer] |= raw[starts[longer] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def _raw(ids: np.ndarray, wide: bool) -> bytes:
    return ids.astype("<u4" if wide else "<u2").tobytes()


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.uint32)


_RAW = "part int, block int, before long, n long, sizes binary, wide boolean, ids binary, used binary, times binary"


def tokenize(docs: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int | None) -> DataFrame:
    """Blocks of whole documents' ids in ascending order of their keys: (part, block) is a block's place, ``before`` the number of ids in
    the part's earlier blocks, ``keys`` and ``sizes`` tell its documents, ``used`` and ``times`` which ids it has how often."""
    plain = docs.select(F.col(doc_id).alias("key"), F.col(text).cast("string").alias("t"))
    ordered = plain.withColumn("tie", F.xxhash64("t")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, block, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        keys: list[pa.Array] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
            times = np.bincount(ids)
            used = np.flatnonzero(times)
            key = pa.concat_arrays(keys)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "before": pa.array([before], pa.int64()),
                    "n": pa.array([len(ids)], pa.int64()),
                    "sizes": pa.array([np.array([len(x) for x in held], "<u8").tobytes()]),
                    "wide": pa.array([wide]),
                    "ids": pa.array([_raw(ids, wide)], pa.binary()),
                    "used": pa.array([used.astype("<u4").tobytes()], pa.binary()),
                    "times": pa.array([times[used].astype("<u4").tobytes()], pa.binary()),
                    "keys": pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key),
                }
            )

        for batch in small_batches(batches, "t"):
            keys.append(batch.column("key"))
            held += [np.concatenate([x, end]) for x in encode.encode(batch.column("t").to_pylist())]
            if (n := sum(map(len, held))) >= BLOCK_TOKENS:
                yield close()
                block, before, keys, held = block + 1, before + n, [], []
        if held:
            yield close()

    return ordered.select("key", "t").mapInArrow(run, f"{_RAW}, keys array<{plain.schema['key'].dataType.simpleString()}>")


def frequencies(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs; the blocks' own counts, summed in each task and then over all."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for used, times in zip(batch.column("used"), batch.column("times")):
                at = np.frombuffer(used.as_py(), "<u4")
                if len(at) and at[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(at[-1]) + 1 - len(total), np.int64)])
                total[at] += np.frombuffer(times.as_py(), "<u4")
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})

    return tokens.select("used", "times").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 2) -> None:
    """Encodes every whole text and writes the file set to ``path``, documents in ascending order of ``doc_id``.

    Null ids come first; documents that share an id stand in the order of a hash of their texts, and repeated rows are all written. Null
    and empty texts are documents of the end id alone (or of nothing). A block holds whole documents, however long, and about ``BLOCK_TOKENS``
    ids. An empty table gives an empty file set. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    raw = tokenize(docs, doc_id, text, tokenizer, end_id)
    place = scratch_path(spark, "tokens")
    raw.write.parquet(place)
    tokens = spark.read.schema(raw.schema).parquet(place)
    counted = frequencies(tokens).collect()  # a row per id of the vocabulary at most
    order = [r["id"] for r in sorted(counted, key=lambda r: (-r["n"], r["id"]))]
    spark.createDataFrame(list(enumerate(order)), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(order, default=-1) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)

    def recode(batches):
        for batch in batches:
            coded = [pack(ranks.value[_ids(r.as_py(), w)]) for r, w in zip(batch.column("ids"), batch.column("wide").to_pylist())]
            kept = [batch.column(c) for c in ("part", "block", "before", "n", "sizes", "keys")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())],
                names=["part", "block", "before", "n", "sizes", "keys", "control", "data"],
            )

    kind = raw.schema["keys"].dataType.simpleString()
    blocks = tokens.drop("used", "times").mapInArrow(recode, f"part int, block int, before long, n long, sizes binary, keys {kind}, control binary, data binary")
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of a file set: ``start`` is the number of ids before it,
    ``ids`` its ids as little-endian unsigned 32-bit integers, ``ids_crc32`` their checksum."""
    stored = spark.read.parquet(f"{path}/blocks")
    key_type = stored.schema["keys"].dataType.elementType.simpleString()
    ids = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # as long as the vocabulary at most
    by_rank = spark.sparkContext.broadcast(np.array([r["id"] for r in ids], np.uint32))
    sums = stored.groupBy("part").agg(F.sum("n").alias("n")).collect()  # a row per written part
    firsts, total = {}, 0
    for part, n in sorted(tuple(r) for r in sums):
        firsts[part], total = total, total + n

    def decode(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in ("part", "before", "n", "sizes", "control", "data")}
                row = {c: v.as_py() for c, v in row.items()}
                found = by_rank.value[unpack(row["control"], row["data"], row["n"])] if row["n"] else np.zeros(0, np.uint32)
                found = found.astype("<u4")
                sizes = np.frombuffer(row["sizes"], "<u8").astype(np.int64)
                ends = np.cumsum(sizes)
                raw = [found[e - s : e].tobytes() for s, e in zip(sizes, ends)]
                columns = {
                    "doc_id": batch.column("keys")[r].values,
                    "start": pa.array(firsts[row["part"]] + row["before"] + ends - sizes),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long"
    return stored.mapInArrow(decode, schema + (", ids binary" if with_ids else ""))
