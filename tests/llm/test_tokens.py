"""Token files, token lengths and packing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelspark.llm.common import tokenizer_path
from panelspark.llm.packing import best_bounds, pack_documents, pack_lengths
from panelspark.llm.token_file import pack, read_tokens, unpack, write_tokens
from panelspark.llm.tokens import PRE_TOKENS, ChunkEncoder, _Ids, encode_pieces, load, split_part

PATH = tokenizer_path("byte_bpe_50k.json")
TEXTS = [None, "", "  a  b\n\n c ", "\n", " ", "don't  'll x\ty z", "x <|endoftext|> y", "a \n b\n\n\n", "été  \n 12 3!!  ?", "日本語 　テキスト", "one two  three", "word " * 30000, "\x00\x1c a"]


def test_chunks_like_library():
    whole, e = Tokenizer.from_file(PATH), ChunkEncoder(PATH, keep=20)
    rng = random.Random(1)
    mixed = ["".join(rng.choices([" ", "\n", "a", "bc", "'s", "!", "é", "7", "\t"], weights=[9, 3, 5, 5, 2, 2, 2, 2, 0.2], k=40)) for _ in range(300)]
    for texts in (TEXTS, mixed, mixed[:50], TEXTS):
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in e.encode(texts)] == want
        assert e.lengths(texts).tolist() == [len(w) for w in want]


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for values in ([], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], rng.integers(0, 2**32, 1001), rng.integers(0, 300, 999)):
        v = np.array(values, np.uint32)
        control, data = pack(v)
        assert len(control) == -(-len(v) // 4)
        assert (unpack(control, data, len(v)) == v).all()


def test_file_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no key"), (3, "twice"), (3, "twice"), (3, "third"), (-4, "below")]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as ids", "2 as part").repartition(5)
    write_tokens(docs, str(tmp_path / "a"), PATH, end_id=2)
    got = read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    whole = Tokenizer.from_file(PATH)
    code = lambda t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=str) == sorted(((d, code(t)) for d, t in rows), key=str)
    at, last = 0, -(10**9)
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        at += r["n_tokens"]
        assert (r["doc_id"] if r["doc_id"] is not None else last) >= last
        last = r["doc_id"] if r["doc_id"] is not None else last
    ranks = {r["id"]: r["rank"] for r in spark.read.parquet(str(tmp_path / "a/ranks")).collect()}
    counts = np.bincount(np.concatenate([np.frombuffer(code(t), "<u4") for _, t in rows]))
    assert all(counts[a] >= counts[b] for a in ranks for b in ranks if ranks[a] < ranks[b])
    write_tokens(docs.limit(0), str(tmp_path / "b"), PATH)
    assert read_tokens(spark, str(tmp_path / "b")).collect() == []


def plain_padding(lengths, counts, buckets):
    best = {(0, 0): 0}
    for j in range(1, len(lengths) + 1):
        for k in range(1, buckets + 1):
            options = [best[i, k - 1] + sum(c * (lengths[j - 1] - x) for x, c in zip(lengths[i:j], counts[i:j])) for i in range(j) if (i, k - 1) in best]
            if options:
                best[j, k] = min(options)
    return min(v for (j, _), v in best.items() if j == len(lengths))


@pytest.mark.parametrize("buckets", [1, 3, 5])
def test_bounds_are_optimal(buckets):
    rng = random.Random(buckets)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 14)))
        counts = [rng.randint(1, 30) for _ in lengths]
        bounds = best_bounds(np.array(lengths), np.array(counts), buckets)
        assert len(bounds) <= buckets and bounds[-1] == lengths[-1] and bounds == sorted(set(bounds))
        got = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
        assert got == plain_padding(lengths, counts, buckets)
    assert best_bounds(np.zeros(0), np.zeros(0), 3) == []


def test_packing(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 2, 7, 7, 7, 40, rng.randint(1, 300)])) for i in range(500)] + [(None, 3), (4, 5), (4, 5), (900, None), (901, 0), (902, 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, n long").selectExpr("*", "1 as bucket", "2 as piece", "3 as part").repartition(7)
    got = pack_lengths(docs, "doc_id", "n", context=64, buckets=4, budget=256).collect()
    pieces = sorted((str(d), s, min(64, n - s)) for d, n in rows if n for s in range(0, n, 64))
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"]) for r in got) == pieces
    seen = {}
    for r in got:
        assert r["piece"] * 64 == r["start"] and r["n_tokens"] <= r["bucket_len"] and r["padding"] == r["bucket_len"] - r["n_tokens"]
        slots = seen.setdefault((r["bucket"], r["batch"]), [])
        slots.append(r["slot"])
        assert r["bucket_len"] * (r["slot"] + 1) <= 256
    for (b, n), slots in seen.items():
        assert sorted(slots) == list(range(len(slots)))
        if (b, n + 1) in seen:
            assert len(slots) == 256 // next(r["bucket_len"] for r in got if r["bucket"] == b)
    lengths, counts = np.unique([p[2] for p in pieces], return_counts=True)
    assert sum(r["padding"] for r in got) == plain_padding(lengths.tolist(), counts.tolist(), 4)
    assert pack_lengths(docs.limit(0), "doc_id", "n", context=64, budget=256).collect() == []


def test_packing_of_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = pack_documents(docs, PATH, context=100, budget=1000, buckets=3).collect()
    whole = Tokenizer.from_file(PATH)
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == {i: 1 + len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}


def test_parts_like_pattern():
    """Parts that are cut without the pattern, and the text around them, give what the pattern gives."""
    rng = random.Random(3)
    letters = ["a", "B", "é", "ß", "ñ", "日", "́", "ا", "7", "_", "'", "'s", ".", ",", ";", ":", "!", "?", ")", "(", "*", "ª", "ǅ"]
    for _ in range(5000):
        part = "".join(rng.choices(letters, k=rng.randrange(0, 5)))
        assert split_part(part) == PRE_TOKENS.findall(" " + part)
        assert split_part("\n" + part) == PRE_TOKENS.findall("\n" + part) and split_part("\0" + part) == PRE_TOKENS.findall(part)
    pieces = ["a", " ÿ", "\n", "日本", "\x00", "", " zebra"]
    sizes, ids = encode_pieces(load(PATH), [p for p in pieces if p])
    assert ids.tolist() == [i for p in pieces for i in Tokenizer.from_file(PATH).encode(p, add_special_tokens=False).ids] and sizes.sum() == len(ids)
    assert [len(x) for x in encode_pieces(load(PATH), [])] == [0, 0]
    known = _Ids()
    assert known.number(pa.array(["x", "y", "x"])).tolist() == [0, 1, 0] and known.fresh == ["x", "y"]
    assert known.number(pa.array(["z", "y"])).tolist() == [2, 1] and known.fresh == ["z"] and known.number(pa.array([], pa.string())).tolist() == []
