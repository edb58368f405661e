"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts drawn from all rows, whatever their label, are the unlabelled ones. A logistic classifier over the presence of words, and of beginnings that several words share, minimises
prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]): the second term is the risk of the negatives, corrected by the class prior,
and is not allowed below zero. Its signs are those whose share among positives exceeds that among the
unlabelled most, and by some standard errors at least, chosen by a Spark count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .winnowing import _WORD_BYTES

POSITIVES, UNLABELLED = 3000, 9000  # bounds of the training sample
CANDIDATES, WORDS = 50_000, 1024  # bounds of the signs that are counted and of those that are used
SPREAD = 24  # tasks that count the sample
STEMS = range(4, 9)  # lengths of word beginnings, in bytes
APART = 4.0  # standard errors by which a sign's share among positives is the higher one at least


def words_of(text: str | None) -> Counter:
    """Words with how often they occur: runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split())


def signs_of(words: Counter) -> set[bytes]:
    """Words, and beginnings that at least 2 or 4 words share (``stem-2``, ``stem-4``)."""
    stems: dict[bytes, int] = {}
    for w, n in words.items():
        for k in STEMS[: max(0, len(w) - STEMS[0] + 1)]:
            stem = w[:k]
            stems[stem] = stems.get(stem, 0) + n
    out = {stem + b"-2" for stem, n in stems.items() if n >= 2} | {stem + b"-4" for stem, n in stems.items() if n >= 4}
    out.update(words)
    return out


class SignFinder:
    """Finds given signs: only words that begin like one of their stems are looked at closely."""

    def __init__(self, signs: Iterable[bytes]):
        self.signs = frozenset(signs)
        self.stems = frozenset(s[:-2] for s in self.signs if s[-2:-1] == b"-")
        self.begins = frozenset(s[: STEMS[0]] for s in self.stems)

    def find(self, words: Counter) -> set[bytes]:
        """signs_of(words) so far as it is among the given signs."""
        shared: dict[bytes, int] = {}
        for w, n in words.items():
            if w[: STEMS[0]] in self.begins:
                for k in STEMS[: max(0, len(w) - STEMS[0] + 1)]:
                    if (stem := w[:k]) in self.stems:
                        shared[stem] = shared.get(stem, 0) + n
        out = {stem + level for stem, n in shared.items() for level, least in ((b"-2", 2), (b"-4", 4)) if n >= least}
        return (out | words.keys()) & self.signs


class ToxicityModel:
    """Weights of signs, and a bias."""

    def __init__(self, signs: Sequence[bytes], weights: np.ndarray, bias: float):
        self.number = {w: i for i, w in enumerate(signs)}
        self.finder = SignFinder(signs)
        self.weights, self.bias = weights, bias

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            total[i] += sum(self.weights[self.number[w]] for w in self.finder.find(words_of(t)))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, slack: float = 0.0
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk over two 0/1 matrices, by full-batch Adam steps.

    Where the corrected negative risk is under -``slack``, the step goes against it, so that it rises again."""
    p, u = positive.astype(np.float32), unlabelled.astype(np.float32)
    w, b = np.zeros(p.shape[1], np.float64), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        gp, gu = p @ w.astype(np.float32) + b, u @ w.astype(np.float32) + b
        sp, su = sigmoid(gp), sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        of_p, of_u = -prior * sp / len(p), su / len(u)  # slope of the negative risk
        if negative >= -slack:
            of_p = of_p - prior * (1 - sp) / len(p)
        else:
            of_p, of_u = -of_p, -of_u
        slope = np.append(p.T @ of_p.astype(np.float32) + u.T @ of_u.astype(np.float32) + decay * w, of_p.sum() + of_u.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _sampled(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str, text: str, label_id: str, label: str) -> DataFrame:
    """(positive, t): POSITIVES confirmed toxic texts at most, and UNLABELLED texts at most from all rows that may be learned from, whatever
    their label, so that the class prior holds among them. Both are taken by the order of a hash of their ids."""
    toxic = labels.where(F.col(label) == 1).select(F.col(label_id).cast("long").alias("id")).distinct()
    ids = docs.where(learn & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id")).distinct()
    marked = materialize(ids.join(toxic.withColumn("positive", F.lit(True)), "id", "left"), "ids")
    confirmed = marked.where("positive").orderBy(F.xxhash64("id"), "id").limit(POSITIVES)
    any_row = marked.orderBy(F.xxhash64("id", F.lit("any")), "id").limit(UNLABELLED).withColumn("positive", F.lit(False))
    some = materialize(confirmed.unionByName(any_row), "sample")
    texts = docs.where(learn).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    return texts.join(F.broadcast(some), "id").select("id", "positive", "t")  # at most POSITIVES + UNLABELLED ids


def _again(words: list[dict]) -> Counter:
    return Counter({w["word"]: w["n"] for w in words})


def _counted(rows: DataFrame, among: set[bytes] | None) -> DataFrame:
    """(sign, n): texts of the sample that have a sign, of all or of given ones; counted in each task, then summed."""
    finder = None if among is None else SignFinder(among)

    def run(batches):
        counter: Counter = Counter()
        for batch in batches:
            for row in batch.column("words"):
                words = _again(row.as_py())
                counter.update(signs_of(words) if finder is None else finder.find(words))
        yield pa.RecordBatch.from_pydict({"sign": pa.array(list(counter), pa.binary()), "n": pa.array(list(counter.values()), pa.int64())})

    return rows.select("words").mapInArrow(run, "sign binary, n long").groupBy("sign").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic"
) -> ToxicityModel:
    """Learns from the rows of ``docs`` where ``learn`` holds; a label of 1 confirms a positive, and all rows, those included, count as unlabelled.
    The class prior is the share of 1 among the labels of such rows. Without a positive every score is the prior."""
    learnable = docs.where(learn).select(F.col(doc_id).alias(label_id)).distinct()
    seen = labels.where(F.col(label).isNotNull()).join(learnable, label_id, "left_semi")
    share = seen.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("k")).first()
    prior = min(0.5, (share["k"] + 0.5) / (share["n"] + 1))

    plain = _sampled(docs, labels, learn, doc_id, text, label_id, label)

    def split(batches):
        for batch in small_batches(batches, "t", 1 << 20):
            words = [sorted(words_of(t.as_py()).items()) for t in batch.column("t")]
            kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
            words = pa.array([[{"word": w, "n": n} for w, n in ws] for ws in words], kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("positive"), words], names=["id", "positive", "words"])

    rows = plain.mapInArrow(split, "id long, positive boolean, words array<struct<word:binary,n:int>>")
    rows = rows.dropDuplicates(["positive", "words"])  # copies tell nothing new
    rows = materialize(rows.repartition(SPREAD), "sample_words")
    size = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
    n_pos, n_unl = size.get(True, 0), size.get(False, 0)
    if not n_pos or not n_unl:
        return ToxicityModel([], np.zeros(0), float(np.log(prior / (1 - prior))))
    often = _counted(rows.where("positive"), None).where("n >= 5").orderBy(F.desc("n"), "sign").limit(CANDIDATES)
    in_pos = {bytes(r["sign"]): r["n"] for r in often.collect()}
    in_unl = {bytes(r["sign"]): r["n"] for r in _counted(rows.where("not positive"), set(in_pos)).collect()}
    apart = {}
    for w, p in in_pos.items():
        u = in_unl.get(w, 0)
        usual = (p + u + 1) / (n_pos + n_unl + 2)
        apart[w] = (p / n_pos - u / n_unl) / np.sqrt(usual * (1 - usual) * (1 / n_pos + 1 / n_unl))
    words = sorted((w for w in apart if apart[w] >= APART), key=lambda w: (-apart[w], w))[:WORDS]
    number, finder = {w: i for i, w in enumerate(words)}, SignFinder(words)

    def look(batches):
        for batch in batches:
            found = [[number[w] for w in finder.find(_again(ws))] for ws in (x.as_py() for x in batch.column("words"))]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.list_(pa.int32()))], names=["positive", "words"])

    got = rows.select("positive", "words").mapInArrow(look, "positive boolean, words array<int>").collect()  # a bounded sample
    x = {True: np.zeros((n_pos, len(words)), np.float32), False: np.zeros((n_unl, len(words)), np.float32)}
    at = {True: 0, False: 0}
    for r in got:
        x[r["positive"]][at[r["positive"]], r["words"]] = 1
        at[r["positive"]] += 1
    weights, bias = train(x[True], x[False], prior)
    return ToxicityModel(words, weights, bias)


def predict(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", extra: Column | None = None, limit: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; ``extra`` fills held_out. The score is between 0 and 1; null and empty texts have
    the score of a text without words. predicted is 1 from ``limit`` on. Nothing but the text is looked at."""
    extra = F.lit(False) if extra is None else extra
    plain = docs.select(F.col(key).alias("doc_id"), extra.alias("held_out"), F.col(text).cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS weights

    def run(batches):
        for batch in small_batches(batches, "t"):
            score = shared.value.score(batch.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= limit).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", limit: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose score is ``limit`` or more; all columns and rows stay else, repeated ones too."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_batches(batches, text):
            score = shared.value.score(batch.column(text).to_pylist())
            yield batch.filter(pa.array(score < limit))

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, docs.schema)
