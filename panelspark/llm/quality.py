"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are computed where the text lies; a bounded sample of labelled rows trains the trees on the driver. Each tree grows level by level from
histograms of binned statistics, and all trees are flattened into parallel arrays (statistic, threshold, children, value) that numpy
follows for all rows and trees at once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 20_000  # labelled rows that are learned from, at most
BINS = 64

# Fixed classes of ASCII bytes.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".!?",
    "comma": b",;:",
    "symbol": b"#$%&*@^~<>=+/\\|_{}[]",
    "quote": b"\"'()",
    "bang": b"!",
    "bar": b"|",
}
_TABLE = np.zeros((len(_CLASSES) + 1, 256))
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLE[_i, list(_bytes)] = 1
_TABLE[-1, 128:] = 1
NAMES = (
    *[f"share_{c}" for c in _CLASSES], "share_other", "bytes", "words", "word_length", "distinct_words", "commonest_word", "short_words",
    "words_per_stop", "lines", "distinct_lines", "words_per_line", "repeated_runs", "upper_words", "marked_words", "longest_line_share",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of NAMES; all zero for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    visible = max(1, len(raw) - int(counts[[9, 10, 11, 12, 13, 32]].sum()))
    shares = (_TABLE @ counts) / visible
    n, seen = len(words), Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    runs = {*zip(words, words[1:], words[2:])}
    marked = sum(c for w, c in seen.items() if not (w[-1:].isalpha() or w[-1] >= 0x80 or w[-1] in b".,;:!?"))
    upper = sum(c for w, c in seen.items() if len(w) > 1 and w.upper() == w and w.lower() != w)
    short = sum(c for w, c in seen.items() if len(w) <= 3)
    stops = int(counts[list(b".!?")].sum())
    return [
        *shares.tolist(), float(np.log1p(len(raw))), float(np.log1p(n)), visible / n, len(seen) / n, seen.most_common(1)[0][1] / n, short / n,
        n / (1 + stops), float(np.log1p(len(lines))), len(set(lines)) / len(lines), n / len(lines), 1 - len(runs) / max(1, n - 2), upper / n,
        marked / n, max(map(len, lines)) / len(raw),
    ]


class Trees:
    """Flattened trees. A node at ``i`` sends a row left (to ``child[i]``) if its statistic is at most ``threshold[i]``, else to
    ``child[i] + 1``; a leaf is its own child."""

    def __init__(self, base: float):
        self.base, self.depth, self.roots = base, 0, np.zeros(0, np.int64)
        self.feature, self.threshold = np.zeros(0, np.int64), np.zeros(0)
        self.child, self.value = np.zeros(0, np.int64), np.zeros(0)

    def add(self, feature: list[int], threshold: list[float], child: list[int], value: list[float], depth: int) -> None:
        n = len(self.feature)
        self.roots = np.append(self.roots, n)
        self.feature, self.threshold = np.append(self.feature, feature), np.append(self.threshold, threshold)
        self.child, self.value = np.append(self.child, np.array(child, np.int64) + n), np.append(self.value, value)
        self.feature, self.depth = self.feature.astype(np.int64), max(self.depth, depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            down = self.child[at]
            right = x[row, self.feature[at]] > self.threshold[at]
            at = np.where(down == at, at, down + right)
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def train(
    x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.1, least_rows: float = 20, penalty: float = 1.0
) -> Trees:
    """Boosted trees for the logistic loss; splits by gain over histograms of at most BINS quantile bins."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin b: x <= cuts[b]
    cell = bins + np.arange(f) * BINS
    margin = np.full(n, model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold, child, value = [0], [0.0], [0], [0.0]
        node, front = np.zeros(n, np.int64), [0]
        for level in range(depth + 1):
            place = np.full(len(feature), -1)
            place[front] = np.arange(len(front))
            live = np.flatnonzero(place[node] >= 0)
            flat = (place[node[live]][:, None] * (f * BINS) + cell[live]).ravel()
            size = len(front) * f * BINS
            g, h, c = (np.bincount(flat, np.repeat(v[live], f), size).reshape(len(front), f, BINS) for v in (grad, hess, np.ones(n)))
            gs, hs = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
            gl, hl, cl = (np.cumsum(v, axis=2) for v in (g, h, c))
            total = c[:, 0].sum(axis=1)[:, None, None]
            gr, hr = gs[:, None, None] - gl, hs[:, None, None] - hl
            gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - (gs**2 / (hs + penalty))[:, None, None]
            gain[(cl < least_rows) | (total - cl < least_rows)] = -np.inf
            best = gain.reshape(len(front), -1).argmax(axis=1)
            after = []
            for i, at in enumerate(front):
                value[at] = float(-rate * gs[i] / (hs[i] + penalty))
                child[at] = at
                j, b = divmod(int(best[i]), BINS)
                if level == depth or not gain[i, j, b] > 1e-6 or b >= len(cuts[j]):
                    continue
                feature[at], threshold[at], child[at] = j, float(cuts[j][b]), len(feature)
                after += [len(feature), len(feature) + 1]
                for column in (feature, threshold, child, value):
                    column += [0, 0]
                mine = live[node[live] == at]
                node[mine] = child[at] + (bins[mine, j] > b)
            front = after
            if not front:
                break
        for i in front:
            child[i] = i
        kept = np.array(value)
        inner = np.array([c != i for i, c in enumerate(child)])
        kept[inner] = 0
        margin = margin + kept[node]
        model.add(feature, threshold, child, kept.tolist(), depth)
    return model


def with_statistics(docs: DataFrame, key: str, text: str, *extra: Column) -> DataFrame:
    """(key, extra..., x): the statistics of every row's whole text."""
    plain = docs.select(F.col(key).alias("key"), *extra, F.col(text).cast("string").alias("t"))
    kept = plain.columns[:-1]

    def run(batches):
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.list_(pa.float64()))], names=[*kept, "x"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema[:-1])
    return plain.mapInArrow(run, f"{fields}, x array<double>")


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality"
) -> Trees:
    """Learns from labelled rows of ``docs`` where ``learn`` holds: SAMPLE at most, by the order of a hash of their ids. Contrary labels of one id
    count as their least. Without labels of both kinds every score is the labels' smoothed share."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(label_id).cast("long").alias("id")).agg(F.min(label).cast("double").alias("y"))
    ids = docs.where(learn & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id")).distinct()
    some = materialize(known.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(SAMPLE), "sample")
    texts = docs.where(learn).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    rows = texts.join(F.broadcast(some), "id")  # SAMPLE ids at most
    got = with_statistics(rows, "id", "t", F.col("y")).dropDuplicates(["key"]).collect()
    got.sort(key=lambda r: r["key"])
    x = np.array([r["x"] for r in got], np.float64).reshape(-1, len(NAMES))
    return train(x, np.array([r["y"] for r in got], np.float64))


def predict(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text", extra: Column | None = None, limit: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; ``extra`` fills held_out. Null and empty texts are scored by statistics of
    zero. predicted is 1 from ``limit`` on. Nothing but the text is looked at."""
    extra = F.lit(False) if extra is None else extra
    plain = docs.select(F.col(key).alias("doc_id"), extra.alias("held_out"), F.col(text).cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # rounds * 2**(depth + 1) nodes at most

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("t")], np.float64).reshape(-1, len(NAMES))
            parts = [shared.value.score(x[i : i + 2048]) for i in range(0, len(x), 2048)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= limit).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
