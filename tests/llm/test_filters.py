"""MaxScore, URL filter and winnowing against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm.maxscore import Shard, top_k
from panelspark.llm.queries import RULES
from panelspark.llm.url_reputation import judge_urls
from panelspark.llm.winnowing import contamination, gram_hashes, winnow, word_hashes


def plain_top(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * x) for x in v]
            ok[i] = min(ok.get(i, whole), whole)
    out = []
    for q in sorted(i for i in ok if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(ok[q], ok[i])), i) for i in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_top_like_plain(spark, spread):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, spread, 12).tolist()) for i in range(400)]
    rows += [(500 + i, rows[20][1]) for i in range(30)] + [(550, [0.0] * 12), (600, [-5.0] * 12), (601, [5.0] * 12)]
    rows += [(None, rows[0][1]), (700, None), (710, [1.0, None] * 6), (720, [float("nan")] * 12), (730, [math.inf] * 12), (740, []), (750, [0.5] * 3), (3, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as shard", "2 as score")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = top_k(table, F.col("vec_id") % 10 == 0, shard_rows=50, block_queries=7)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 5, 10)
    assert top_k(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert top_k(table, F.lit(False)).collect() == []
    assert len(top_k(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()) == 2


def test_shard_skips_rows():
    """Sparse vectors: rows in no essential postings are not scored."""
    rng = np.random.default_rng(2)
    v = np.where(rng.random((300, 40)) < 0.05, rng.integers(-9, 10, (300, 40)), 0).astype(float)
    shard = Shard(np.arange(300), v)
    for i in range(300):
        ids, scores = shard.top(v[i], i, 5)
        want = sorted((-(v[i] @ v[j]), j) for j in range(300) if j != i)[:5]
        assert list(zip((-scores).tolist(), ids.tolist())) == want


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text)) if fit else None
    return host, path, best.text if best else None, best.verdict if best else None


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG/en/12?x", "https://example.org/es/", "https://x.org", "https://x.org/", "HTTP://myorg/", "http://b.com/de/1", "http://com/fr/x#y", "http://evil.net/a", "http://fine.net?x://y/", "http://new.net/ä", "a://b://c/d"]
    rows = [(i, u, None, "h") for i, u in enumerate(urls)] + [(4, urls[4], 1, "h"), (None, urls[4], 0, "h")]
    rows += [(100 + i, "http://evil.net/p", 1, "h") for i in range(80)] + [(200 + i, "http://fine.net/p", int(i % 20 == 0), "h") for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad int, host string")
    got = judge_urls(pages, RULES, outcome=F.col("bad")).collect()
    assert len(got) == len(rows)
    urls_of = {}
    for i, u, *_ in rows:
        urls_of.setdefault(i, u)
    for r in got:
        host, path, rule, verdict = plain_verdict(urls_of[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if host == "evil.net" else "allow"))
        assert 0 <= r["bad_bound"] <= r["bad_rate"] <= 1
    by_host = {r["host"]: r for r in got}
    assert by_host["evil.net"]["n_labelled"] == 80 and by_host["evil.net"]["bad_rate"] > 0.8 and by_host["fine.net"]["bad_rate"] < 0.2
    assert by_host["fine.net"]["bad_rate"] < by_host["new.net"]["bad_rate"] < by_host["evil.net"]["bad_rate"]
    assert judge_urls(pages.limit(0), RULES).collect() == []
    assert {r["bad_rate"] for r in judge_urls(pages, RULES).collect()} == {0.5}


def plain_hits(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        for a in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[a : a + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (which := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    found |= which
        out.append((d, len(w), sorted(hit), sorted(x for x in found if x is not None)))
    return out


def test_hits_like_plain(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice(["", "1", "é"])
    items = [(i, " ".join(word() for _ in range(rng.choice([10, 11, 25, 60])))) for i in range(12)]
    items += [(20, "Short one, of six words here"), (21, "rareword"), (22, ""), (23, None), (24, items[0][1]), (None, items[1][1]), (25, "a b a b a b a b a b a b a b")]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 5, 80])))) for i in range(40)]
    for i in range(60):
        w = rng.choice(items[:12])[1].split()
        n = rng.randint(8, len(w))
        a = rng.randint(0, len(w) - n)
        docs.append((100 + i, " ".join([word(), *w[a : a + n], word()]).translate({c: c - 32 for c in range(97, 123)})))
    docs += [(300, "x short ONE: of six words here rareword"), (301, None), (302, ""), (303, "!!!"), (304, "a b " * 9000), (100, docs[50][1]), (None, items[2][1] + ". " + items[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as fp", "2 as item_id")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame, tests).collect()
    flat = [(r["doc_id"], r["n_words"], [x for h in r["hits"] for x in range(h["lo"], h["hi"])], r["item_ids"]) for r in got]
    assert sorted(flat, key=str) == sorted(plain_hits(docs, items), key=str)
    assert sum(bool(f[2]) for f in flat) > 30
    assert all(not r["hits"] for r in contamination(frame, tests.limit(0)).collect())
    assert contamination(frame.limit(0), tests).collect() == []


def test_winnow_guarantee():
    rng = random.Random(4)
    for _ in range(300):
        shared = [str(rng.randint(0, 3)) for _ in range(10)]
        a, b = ([str(rng.randint(0, 5)) for _ in range(20)] for _ in range(2))
        i, j = rng.randint(0, 20), rng.randint(0, 20)
        kept = []
        for w, at in ((a[:i] + shared + a[i:], i), (b[:j] + shared + b[j:], j)):
            g = gram_hashes(word_hashes(" ".join(w)), 5)
            kept.append({p - at for p in winnow(g, 6) if at <= p <= at + 5})
        assert kept[0] & kept[1]
