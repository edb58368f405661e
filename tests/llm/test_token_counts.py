"""Token counts against the library on whole texts."""

import random
import sys

import pytest
from tokenizers import Tokenizer

from panelspark.llm.common import tokenizer_path
from panelspark.llm.token_counts import TokenCounter, count_tokens, prove_whole
from panelspark.llm.tokens import ODD, PRE_TOKENS

PATH = tokenizer_path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n", "  a  b\n\n c ", "don't  'll x\ty z", "x <|endoftext|> y", "<|endoftext|>", "a \n b\n\n\n", "été  \n 12 3!!  ?", "日本語 　テキスト", "word " * 30000,
    "x" * 50_000, "\x00\x1c a\x85b", "²½Ⅷ ٣ _a_b __", "é ‍ ﻿", "''s 'S it's we'll", "\U0001f600\U0001f468‍\U0001f469",
]


@pytest.fixture(scope="module")
def whole():
    return prove_whole(PATH)


def plain(texts):
    library = Tokenizer.from_file(PATH)
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_classes_like_library():
    """Letters, numbers, other characters and white space are the library's, but for the odd characters."""
    split = Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str
    some = [*range(0x3400), *range(0x3400, 0xD800, 11), *range(0xE000, 0x20000, 3), *range(0x20000, sys.maxunicode + 1, 101)]
    some = [chr(c) for c in some if not ODD[chr(c)]]
    assert len(some) > 25_000
    for before in "x1!":
        for a in range(0, len(some), 20_000):
            text = "".join(f"{before}{c}\n" for c in some[a : a + 20_000])
            assert [e for _, (_, e) in split(text)] == [m.end() for m in PRE_TOKENS.finditer(text)]


def test_whole_tokens(whole):
    library = Tokenizer.from_file(PATH)
    some = random.Random(3).sample(sorted(whole), 2000)
    assert len(whole) > 45_000 and all(len(library.encode(s).ids) == 1 for s in some)
    assert "<|endoftext|>" not in whole and all(PRE_TOKENS.fullmatch(s) for s in some)


@pytest.mark.parametrize("keep", [0, 1 << 20])
def test_counts(whole, keep):
    rng = random.Random(1)
    letters = [" ", "\n", "a", "bc", "'s", "!", "é", "7", "\t", "ing", "The", "<|endoftext|>"]
    mixed = ["".join(rng.choices(letters, weights=[9, 3, 5, 5, 2, 2, 2, 2, 1, 4, 4, 0.1], k=60)) for _ in range(400)]
    counter = TokenCounter(PATH, whole, keep)
    for texts in (TEXTS, mixed, TEXTS, mixed[:50]):
        total, direct = counter.counts(texts)
        assert total.tolist() == plain(texts) and (direct <= total).all()


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no key"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'x' as t", "2 as n_bytes").repartition(4)
    got = sorted([tuple(r) for r in count_tokens(docs, PATH, limit=5).drop("n_direct").collect()], key=str)
    want = [(i, len((t or "").encode()), n, n > 5) for (i, t), n in zip(rows, plain([t for _, t in rows]))]
    assert got == sorted(want, key=str)
    assert count_tokens(docs.limit(0), PATH).collect() == []


def test_other_files_raise():
    with pytest.raises(ValueError):
        prove_whole(tokenizer_path("word_bpe_49k.json"))


def test_query(spark):
    from panelspark.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: n for r, n in zip(docs, plain([r["text"] for r in docs]))}
    got = QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(docs) and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
