"""Substring dedup, SimHash and components against plain versions."""

import itertools
import random
import re

import pytest
import xxhash

from panelspark.llm.components import connected_components
from panelspark.llm.simhash import covering_masks, drop_near_duplicates, fingerprint, hamming_links, refining_masks, shingle_hashes, simhash_classes
from panelspark.llm.substring_dedup import dedup_units

SCHEMA = "doc_id long, text string, digest string, kept string"
CASES = [
    (None, "a line of five words\nother line of five words", "x", None),
    (3, "A  line of\tfive words \nshort\nshort", "x", "k"),
    (3, "A  line of\tfive words \nshort\nshort", "x", "k"),
    (1, "other line of five words\na line of five words\na line of five words", None, None),
    (2, None, None, None),
    (5, "", None, None),
    (6, "\n\n", None, None),
    (7, "a line of five words", None, None),
    (8, "only here stand these words\n" + "very long text " * 20000, None, None),
]


def plain_units(rows, min_words=4):
    def norm(x):
        x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
        return re.sub("[ \t\r\n\x0b\x0c]+", " ", x).strip(" ")

    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for d, t in docs:
        stay, gone, at = [], [], 0
        for line in t.split("\n"):
            n = norm(line)
            if n and len(n.split(" ")) >= min_words and n in seen:
                gone.append((at, at + len(line)))
            else:
                stay.append(line)
                if n and len(n.split(" ")) >= min_words:
                    seen.add(n)
            at += len(line) + 1
        out[d, t] = "\n".join(stay), gone
    return out


def test_units_like_plain(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(40)]
    rows = CASES + [(100 + i, "\n".join(rng.choices(lines, k=rng.randint(0, 8))), None, None) for i in range(80)]
    got = dedup_units(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain_units(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["text"] is None:
            assert r["clean_text"] is None and r["n_units"] == 0 and not r["removed_spans"]
            continue
        text, gone = want[r["doc_id"], r["text"]]
        assert r["clean_text"] == text
        assert [(s["start"], s["end"]) for s in r["removed_spans"]] == gone
        assert "\n".join(r["text"][s["start"] : s["end"]] for s in r["kept_spans"]) == text
        assert r["n_units"] == len(r["kept_spans"]) + len(gone)
    assert got[0].asDict().keys() >= {"digest", "kept"}


def test_units_edges(spark):
    assert dedup_units(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "one two three four\n\nfive six seven eight", "", ""), (2, "Five six\nseven eight\n\nnew", "", "")]
    got = {r["doc_id"]: r for r in dedup_units(spark.createDataFrame(rows, SCHEMA), unit="paragraph").collect()}
    assert got[2]["clean_text"] == "new" and got[1]["clean_text"] == rows[0][1]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as clean_text", "2 as n_units", "3 as text_mark", "4 as cut_doc", "5 as at", "6 as mark")
    got = dedup_units(clash, unit="paragraph").collect()
    assert sorted(r["clean_text"] for r in got) == sorted([rows[0][1], "new"]) and got[0]["text_mark"] == 3


def plain_fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover(radius):
    masks = [m & (1 << 64) - 1 for m in covering_masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & bits == 0 for m in masks)


def near_texts():
    rng = random.Random(3)
    texts = [None, "", "  ", "one", "One", "one two", "\x00é b c d", "x " * 30000]
    for _ in range(25):
        base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 30)) for _ in range(rng.choice([4, 60, 300]))]
        texts.append(" ".join(base))
        for _ in range(4):
            base = list(base)
            base[rng.randrange(len(base))] = "other"
            texts.append(" ".join(base))
    return texts


def test_simhash_like_plain(spark):
    texts = near_texts()
    ids = list(range(len(texts)))
    random.Random(4).shuffle(ids)
    rows = [(i, t) for i, t in zip(ids, texts)] + [(ids[9], texts[9]), (None, texts[10]), (None, "nobody else says this at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as component_id", "'y' as fp0")
    got = simhash_classes(docs, shingle=3, radius=2, words=1).collect()
    fps = {(i, t): plain_fingerprint(t, 3) for i, t in rows}
    roots = plain_components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted(((i, format(fps[i, t], "016x"), least.get(roots[fps[i, t]])) for i, t in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert len(set(least.values())) < len(set(fps.values()))


def test_large_runs_are_compared_in_blocks(spark):
    rng = random.Random(8)
    values = {1 << a | 1 << b for a in range(40) for b in range(a)} | {rng.getrandbits(63) for _ in range(50)}
    fps = spark.createDataFrame([(v,) for v in values], "fp0 long")
    want = plain_components(sorted(values), lambda a, b: (a ^ b).bit_count() <= 2)
    want = {n: r for n, r in want.items() if n != r or list(want.values()).count(n) > 1}
    for block in (16, 400, 1024):
        got = connected_components(hamming_links(fps, 1, 2, block=block)).collect()
        assert {r["node"]: r["root"] for r in got} == want


def test_links_of_several_words(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = sorted({(rng.getrandbits(63), base[rng.randrange(6)] ^ (1 << rng.randrange(60) if rng.random() < 0.5 else 0)) for _ in range(150)})
    fps = spark.createDataFrame(rows, "fp0 long, fp1 long")
    got = {r["node"]: r["root"] for r in connected_components(hamming_links(fps, 2, 2, block=8)).collect()}
    want = plain_components(range(len(rows)), lambda a, b: any((x ^ y).bit_count() <= 2 for x, y in zip(rows[a], rows[b])))
    assert {n: got.get(rows[n][0], rows[n][0]) for n in want} == {n: rows[r][0] for n, r in want.items()}


@pytest.mark.parametrize("radius", [2, 4])
def test_refined_masks_cover(radius):
    masks, finer = covering_masks(radius), refining_masks(radius)
    rng = random.Random(2)
    for _ in range(2000):
        at = rng.randrange(len(masks))
        free = [i for i in range(64) if not masks[at] >> i & 1]
        bits = sum(1 << b for b in rng.sample(free, radius))
        assert any(m & bits == 0 and m & masks[at] == masks[at] for m in finer[at])


def test_drop_near_duplicates(spark):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    near = base[:]
    near[7] = "changed"
    rows = [(5, " ".join(base), "a"), (2, " ".join(near), "b"), (2, " ".join(near), "b"), (9, "quite another text of its own words here", "c"), (None, " ".join(base), "d"), (None, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mine string")
    kept = drop_near_duplicates(docs).collect()
    assert sorted((r["mine"] for r in kept)) == ["b", "c", "e"]
    assert kept[0].asDict().keys() == {"doc_id", "text", "mine"}
    clash = docs.selectExpr("*", "1 as k0", "2 as k1", "3 as text_mark", "4 as kept_id", "5 as root", "6 as fp0")
    assert sorted(r["mine"] for r in drop_near_duplicates(clash).collect()) == ["b", "c", "e"]
    assert drop_near_duplicates(docs.limit(0)).collect() == []


def test_radius_of_the_stage(spark):
    """One row of each plain component stays, whatever the distance of its ends."""
    rng = random.Random(12)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(40, 300))]
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    bits = {i: fingerprint(shingle_hashes(t, 3)) for i, t in rows}
    root = plain_components(sorted(bits), lambda a, b: ((bits[a] ^ bits[b]) & (1 << 64) - 1).bit_count() <= 2)
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root.values())) and 40 <= len(kept) < len(rows)


def test_fingerprint_of_nothing():
    assert fingerprint(shingle_hashes(None, 3)) == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(50)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = connected_components(spark.createDataFrame(edges + edges[:5] + [(7, 7)], "a long, b long")).collect()
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    pairs = {frozenset(e) for e in edges}
    want = plain_components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
