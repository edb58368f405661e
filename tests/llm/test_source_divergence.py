"""Source divergence against a plain computation."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import source_divergence
from panelspark.llm.source_divergence import divergence, term_digest, terms_of


def plain(rows, least=3, top=200):
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in te or ""))) for la, so, te in rows]
    seen, n = defaultdict(Counter), defaultdict(Counter)
    for la, so, words in docs:
        seen[la].update(set(words))
        n[la, so].update(words)
    out = set()
    for la in {d[0] for d in docs}:
        kept = [t for t, k in seen[la].items() if k >= least]
        sources, v = sorted({d[1] for d in docs if d[0] == la}), len(kept)
        whole = sum((n[la, so] for so in sources), Counter())

        def share(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + v) for t in kept}

        p, q = {so: share(n[la, so]) for so in sources}, share(whole)
        for so in sources:
            pairs = [(o, sum((p[so][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != so]
            terms = [(t, (p[so][t] - q[t]) ** 2 // q[t]) for t in kept if n[la, so][t] and p[so][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(la, so, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])}
    return out


def made(seed=5):
    rng = random.Random(seed)
    words = ["The", "the", "été", "Été", "a", "b-c", "x1y", "日本", "zeta", "Ça", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = []
    for _ in range(260):
        la, so = rng.choice(["en", "fr", None, ""]), rng.choice(["hot", "hot", "hot", "s1", "s2", None])
        rows.append((la, so, " ".join(rng.choices(words, k=rng.randint(0, 30)))))
    rows += [("de", "one", "allein"), ("de", "two", ""), ("de", "two", None), ("it", "one", "solo solo solo"), ("en", "empty", None), ("en", "empty", "12 34")]
    return rows + rows[:20] + [("en", "long", "long words " * 200_000), ("en", "s1", "long"), ("en", "s2", "long")]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    return docs.selectExpr("*", "1 as n", "'x' as digest", "2 as part", "'y' as t", "3 as per").repartition(5)


def test_terms_of_long_text():
    text = "Ab cé1d " * 400_000 + "tail"
    assert sum(terms_of(text), []) == re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())


@pytest.mark.parametrize("bits,held", [(64, 400_000), (64, 10), (4, 400_000), (0, 7)])
def test_against_plain(spark, bits, held):
    """With digests of a few bits most terms share theirs."""
    rows = made()
    digest = (lambda t: term_digest(t) & (1 << bits) - 1) if bits < 64 else term_digest
    got = divergence(frame(spark, rows), digest=digest, held=held, top=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, top=5)


def test_nothing_kept(spark):
    rows = [("en", "a", "x y"), ("en", "b", None), (None, None, None)]
    assert {tuple(r) for r in divergence(frame(spark, rows)).collect()} == plain(rows) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence(frame(spark, rows).limit(0)).collect() == []


def test_ties_at_the_last_rank(spark):
    rows = [("en", "a", " ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)))] * 3 + [("en", "b", "other words")] * 4
    got = {tuple(r) for r in divergence(frame(spark, rows)).collect()}
    assert got == plain(rows) and sum(r[1:3] == ("a", "term") for r in got) == 200


def test_shares_and_sums_past_64_bits(spark):
    """Shares whose product passes 64 bits, and a pair's sum of values up to 10**18, both directions of a pair met once."""
    counts = [(0, 1), (10**12, 3 * 10**12), (10**15 - 1, 10**15), (6, 7), (4 * 10**15, 9 * 10**15)]
    df = spark.createDataFrame(counts, "n long, total long").withColumn("terms", F.lit(0).cast("long"))
    got = [r[0] for r in df.select(source_divergence._share(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // total for n, total in counts]

    big = 10**9
    per = [("a", 5), ("b", big), ("c", 1)]
    kept = spark.createDataFrame([("x", per)] * 40 + [("x", [("a", 2)]), ("y", [("a", 3), ("b", 3)])], "lang string, per array<struct<source:string,n:long>>")
    sizes = {("x", "a"): 2 * big, ("x", "b"): 2 * big, ("x", "c"): 2 * big, ("y", "a"): 3, ("y", "b"): 3}
    zero = {k: 1 + 10**9 // (v + 41) for k, v in sizes.items()}
    side = spark.createDataFrame([(*k, v, 41, zero[k]) for k, v in sizes.items()], "lang string, source string, total long, terms long, zero long")
    want = {}
    for lang, rows in (("x", [per] * 40), ("y", [[("a", 3), ("b", 3)]])):
        for a, n in rows[0]:
            for b, m in rows[0]:
                if a != b:
                    p, q = (1 + 10**9 * (k + 1) // (sizes[lang, s] + 41) for s, k in ((a, n), (b, m)))
                    za, zb = zero[lang, a], zero[lang, b]
                    gap = lambda u, v: (u - v) ** 2 // v
                    want[lang, a, b] = len(rows) * (gap(p, q) - gap(p, zb) - gap(za, q) + gap(za, zb))
    got = {(r["lang"], r["source"], r["item"]): int(r["value"]) for r in source_divergence._common(kept, side).collect()}
    assert got == want


def test_counted_texts_like_long_ones():
    """Texts counted together and one by one give the same counts, and each term of a batch leads once."""
    rng = random.Random(4)
    texts = ["", "  ", " a B7b. ", *("".join(rng.choices(["a", "B", "é", " ", "-", "日", "\n"], k=rng.randrange(60))) for _ in range(80))]
    rows = pa.table({"lang": [rng.choice(("", "x", "y")) for _ in texts], "source": [rng.choice(("", "p", "q")) for _ in texts], "t": texts}).combine_chunks()
    want = Counter()
    for batch in rows.to_batches(max_chunksize=1):
        for part in source_divergence._long_text(batch, term_digest):
            for r in part.to_pylist():
                want[r["lang"], r["source"], r["digest"], r["term"], "n"] += r["n"]
                want[r["lang"], r["source"], r["digest"], r["term"], "docs"] += r["docs"]
    got = [r for part in source_divergence._counted_texts(rows, term_digest) for r in part.to_pylist()]
    assert {(r["lang"], r["source"], r["digest"], r["term"], k): r[k] for r in got for k in ("n", "docs")} == dict(want)
    assert Counter(r["term"] for r in got if r["lead"]) == Counter({r["term"] for r in got}) and len(got) > 50
    assert [p.num_rows for p in source_divergence._counted_texts(rows.slice(0, 2).combine_chunks(), term_digest)] == []
