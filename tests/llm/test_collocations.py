"""Collocations against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelspark.llm.collocations import (
    BITS, BurstTrie, Filter, _mixed, collocations, digest_filter, digest_runs, frequent_digests, pair_hashes, parts_of, word_filter, word_hash,
)


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain(rows, least, inside=80, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, n in f.items():
        candidates = {p: a for p, a in n.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            held = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= inside * a for q, b in candidates.items())
            if not held:
                score, k = min((2_000_000 * a // (n[p[:k]] + n[p[k:]]), k) for k in range(1, len(p)))
                kept.append((" ".join(p), a, n[p[:k]], n[p[k:]], score))
        kept.sort(key=lambda x: (-x[4], -x[1], x[0].encode()))
        out |= {(lang, i + 1, p, a, le, r, total[lang], s) for i, (p, a, le, r, s) in enumerate(kept[:top])}
    return out


def made(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "of", "été", "a-b", "日本", "New", "york", "city", "don't", "\x00", "x\x85y", *[f"rare{i}" for i in range(400)]]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(["New York", "new york City", "of the", "the quick brown fox", rng.choice(words), rng.choice(words[:10])])
            text += rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\x0b", "!? "])
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und", ""]), text))
    return rows + [("en", None), ("en", ""), (None, None), ("de", "one two"), ("it", " \n. ")] + rows[:10]


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as n", "'x' as phrase", "2 as rank", "'y' as t", "3 as size").repartition(parts)


@pytest.mark.parametrize("settings", [{}, {"held": 40, "burst": 3, "blocks": 1, "waiting": 50}, {"held": 500, "burst": 2, "blocks": 64, "salts": 2}])
def test_against_plain(spark, settings):
    rows = made(2)
    got = collocations(frame(spark, rows), least=8, top=25, **settings)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in got.collect()]
    want = plain(rows, 8, top=25)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_long_text_is_one(spark):
    """A text of several parts: phrases across the seams are counted."""
    from panelspark.llm import collocations as module

    rng = random.Random(4)
    text = " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee ff gg"], k=3000))
    for size in (1, 7, 100, 1 << 21):
        words = [w for part in parts_of(text.encode(), size) for w in part if w]
        assert words == [*text.encode().split(), b"\xff"]
    rows = [("en", text), ("en", "aa bb"), ("en", "x")]
    keep, module.parts_of.__defaults__ = module.parts_of.__defaults__, (11,)
    try:
        every = Filter(np.full(4, 2**64 - 1, np.uint64))
        state, digests = module._Language("en", every, 4), []
        for _, t in rows:
            state.count(t.encode(), every, every)
            digests += [d for x, seen in state.parts(t.encode()) for d in module.pair_digests(x, seen, state.hashes).tolist()]
        found = Counter({p: n for head in list(state.trie.root) for p, _, n in state.run_of(head)})
    finally:
        module.parts_of.__defaults__ = keep
    for m in (2, 3, 4):
        want = Counter(b" ".join(w[i : i + m]) for _, t in rows for w in [t.encode().split()] for i in range(len(w) - m + 1))
        assert {p: n for p, n in found.items() if p.count(b" ") == m - 1} == want
        if m == 2:
            assert sorted(Counter(digests).values()) == sorted(want.values())
    assert {tuple(r) for r in collocations(frame(spark, rows), least=30).collect()} == plain(rows, 30)


def test_trie_like_a_counter():
    rng, want, trie = np.random.default_rng(1), Counter(), BurstTrie(burst=3)
    for _ in range(30):
        keys = Counter(tuple(int(x) for x in k) for k in rng.integers(1, 5, (60, 4)) * (np.arange(4) < rng.integers(2, 5, (60, 1))))
        packed = sorted(((k[0], k[1] << 2 * BITS | k[2] << BITS | k[3]), n) for k, n in keys.items())
        trie.add(np.array([k[0] for k, _ in packed]), np.array([k[1] for k, _ in packed]), np.array([n for _, n in packed]))
        want.update({k: n for k, n in packed})
        assert len(trie) == len(want)
        if len(trie) > 120:
            for head in trie.largest(60):
                for rest, n in trie.take(head):
                    assert want.pop((head, rest)) == n
            assert len(trie) == len(want) <= 60
    for head in list(trie.root):
        for rest, n in trie.take(head):
            assert want.pop((head, rest)) == n
    assert not want and len(trie) == 0


def test_filter_loses_none(spark):
    rng = random.Random(3)
    rows = [("en", f"w{rng.random()}") for _ in range(500)] + [("fr", f"a{rng.random()}") for _ in range(500)]
    found = word_filter(spark.createDataFrame(rows, "lang string, phrase string").repartition(3), 256)
    assert found.may_hold(np.array([word_hash(la.encode(), w.encode()) for la, w in rows], np.uint64)).all()
    others = np.random.default_rng(0).integers(0, 2**63, 10_000, np.uint64)
    assert found.may_hold(others).sum() < 3000
    digests = others[:700] >> np.uint64(16)
    held = digest_filter(spark.createDataFrame([(int(d),) for d in digests], "digest long").repartition(3), 256)
    assert held.may_hold(_mixed(digests)).all() and held.may_hold(_mixed(others[700:] >> np.uint64(16))).sum() < 3000


def test_counts_by_digest(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    every = Filter(np.full(4, 2**64 - 1, np.uint64))
    plain = spark.createDataFrame([("en", t) for t in texts], "lang string, t string").repartition(3)
    h = {w: np.array([word_hash(b"en", w.encode())], np.uint64) for w in "abcdefgh"}
    pairs = Counter((a, b) for t in texts for a, b in zip(t.split(), t.split()[1:]))
    got = frequent_digests(digest_runs(plain, every, None, 8, 50), 20)
    assert sorted(r["digest"] for r in got.collect()) == sorted(int(pair_hashes(h[a], h[b])[0] >> np.uint64(16)) for (a, b), n in pairs.items() if n >= 20)
    often = digest_filter(got, 1 << 12)  # large enough to be nearly exact
    triples = Counter(w for t in texts for w in zip(t.split(), t.split()[1:], t.split()[2:]))
    found = {r["digest"] for r in frequent_digests(digest_runs(plain, every, often, 8, 50), 4).collect()}
    want = {int(pair_hashes(pair_hashes(h[a], h[b]), h[c])[0] >> np.uint64(16)) for (a, b, c), n in triples.items() if n >= 4 and pairs[a, b] >= 20 <= pairs[b, c]}
    assert want <= found and len(found) < len(want) + 20 and len(want) > 10


def test_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a = 9_000_000_000_000_000_000
    got = spark.range(1).select(F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * F.lit(a).cast("decimal(20,0)"), F.lit(a).cast("decimal(20,0)") + F.lit(a - 1)).alias("x"))
    assert got.first()[0] == 2_000_000 * a // (2 * a - 1)


def test_nothing(spark):
    assert collocations(frame(spark, [("en", "a b")]).limit(0)).collect() == []
    assert collocations(frame(spark, [("en", "a b"), (None, None)])).collect() == []
