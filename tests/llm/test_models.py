"""Language ID, toxicity and quality: exact parts against plain versions, models by held-out accuracy."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from panelspark.llm import langid, quality, toxicity
from panelspark.llm.common import held_out, tokenizer_path
from panelspark.llm.queries import op6_language, op8_toxicity, op10_quality

VOCABULARY = tokenizer_path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01"


def segmentations(word):
    for n in range(len(word)):
        for cuts in itertools.combinations(range(1, len(word)), n):
            at = [0, *cuts, len(word)]
            yield [word[a:b] for a, b in zip(at, at[1:])]


def test_forward_sums_all_segmentations():
    pieces = langid._pieces(VOCABULARY)
    number = {p: i for i, p in enumerate(pieces.pieces)}
    rng = np.random.default_rng(0)
    probability = np.vstack([rng.random((len(pieces), 2)), np.zeros((1, 2))])
    words = [b" the", b" ering", "né".encode(), b" a", b"x", b" thnterbl"]
    got = langid.word_scores(pieces, probability, words)
    for w, row in zip(words, got):
        want, uses = 0, {}
        for s in segmentations(w):
            if all(p in number for p in s):
                chance = math.prod(probability[number[p], 0] for p in s)
                want += chance
                for p in s:
                    uses[number[p]] = uses.get(number[p], 0) + chance
        assert math.isclose(row[0], math.log(want), rel_tol=1e-9)
        expected = langid.expected_uses(pieces, probability[:, 0], [w], np.array([3.0]))
        for i in np.flatnonzero(expected):
            assert math.isclose(expected[i], 3 * uses[i] / want, rel_tol=1e-9)
        assert len(np.flatnonzero(expected)) == len(uses)


def test_language_edges(spark):
    rows = [(1, "the cat sat on the mat with the hat", "en"), (2, "der hund und die katze sind im haus", "de"), (3, "the dog", None), (None, "das haus", "de"), (5, None, "en"), (6, "", "de"), (7, "123 !!", "en"), (8, "²", None), (9, "the cat " * 20000, None), (9, "the cat " * 20000, None), (10, "x" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' as lang_pred", "1 as score")
    model = langid.fit(docs, VOCABULARY)
    assert model.languages == ["de", "en"] and np.allclose(model.probability.sum(axis=0), 1)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["lang_pred"] == "en" and by[2]["lang_pred"] == "de" and by[9]["lang_pred"] == "en"
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (5, 6, 7, 8))
    assert all(0 <= r["score"] <= 1 for r in got)
    empty = docs.limit(0)
    assert langid.predict(empty, langid.fit(empty, VOCABULARY)).collect() == []
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty, VOCABULARY)).collect()} == {"und"}


def test_language_held_out(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op6_language(spark, SF).join(lang, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97


def test_risk_is_not_negative():
    """With few positives a plain corrected risk goes below zero; the trained one stays useful."""
    rng = np.random.default_rng(1)
    p, u = (rng.random((n, 60)) < 0.1 for n in (60, 600))
    p[:, 0], u[:, 0] = True, rng.random(600) < 0.15
    w, b = toxicity.train(p, u, 0.15)
    score = 1 / (1 + np.exp(-(u @ w + b)))
    assert score[u[:, 0]].mean() > 0.6 > 0.2 > score[~u[:, 0]].mean()


def test_finder_like_all_signs():
    rng = random.Random(4)
    for _ in range(200):
        words = toxicity.words_of(" ".join("".join(rng.choices("abé", k=rng.randint(1, 11))) for _ in range(rng.randint(0, 60))))
        every = toxicity.signs_of(words)
        some = {s for s in every if rng.random() < 0.3} | {b"aaaa-2", b"zzzz-4", b"zz"}
        assert toxicity.SignFinder(some).find(words) == every & some


def _auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = op8_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r["toxic"] for r in got]), np.array([r["score"] for r in got])
    hit = np.array([r["predicted"] for r in got])
    assert _auc(s, y) > 0.9
    assert hit[y == 1].mean() > 0.8 and hit[y == 0].mean() < 0.05


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = op10_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    y, hit = np.array([r["quality"] for r in got]), np.array([r["predicted"] for r in got])
    assert _auc(np.array([r["score"] for r in got]), y) > 0.9 and (y == hit).mean() > 0.93


def test_classifier_edges(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=9)) + (" idiot" if i % 5 == 0 else ""), "s") for i in range(200)]
    rows += [(None, "no id", "s"), (300, None, "s"), (301, "", "s"), (302, "long " * 50000, "s"), (7, rows[7][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").selectExpr("*", "1 as positive", "2 as t", "3 as y", "4 as id", "5 as words")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 200, 2)] + [(4, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    learn = F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1)
    for module, model in ((toxicity, toxicity.fit(docs, labels, learn)), (quality, quality.fit(docs, labels, learn))):
        got = module.predict(docs, model, extra=held_out("doc_id", 3, 1)).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        assert module.predict(docs.limit(0), model).collect() == []
        none = module.fit(docs, labels.limit(0), learn)
        assert len({r["score"] for r in module.predict(docs, none).collect()}) == 1
        module.fit(docs.limit(0), labels, learn)
    kept = toxicity.drop_toxic(docs, toxicity.fit(docs, labels, learn)).collect()
    assert not any("idiot" in (r["text"] or "") for r in kept) and len(kept) > 120


def test_flat_trees_like_nested():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 5)).round(1)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = quality.train(x, y, rounds=25)
    margin = trees.margin(x[:100])
    for row, m in zip(x[:100], margin):
        total = trees.base
        for at in trees.roots:
            while trees.child[at] != at:
                at = trees.child[at] + (row[trees.feature[at]] > trees.threshold[at])
            total += trees.value[at]
        assert math.isclose(total, m, rel_tol=1e-9)
    assert ((trees.score(x) > 0.5) == (y == 1)).mean() > 0.9
