"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over all its
segmentations into pieces, found by a forward pass; a text's is the product over its words. Piece probabilities are
learned by expectation-maximisation on the word counts of all labelled training documents: the expected use of each piece comes
from forward and backward sums, in Spark tasks, and only piece totals (vocabulary times languages) reach the driver.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import slices

LONGEST_PIECE = 12
LONGEST_WORD = 32  # bytes; longer words are cut at character borders
_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_KEEP = 300_000
_BLOCK = 20_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return [w for w in _WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def _cut(word: str) -> list[bytes]:
    raw = (" " + word).encode("utf-8", "surrogatepass")
    out = []
    while len(raw) > LONGEST_WORD:
        end = LONGEST_WORD
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[:end])
        raw = raw[end:]
    return [*out, raw]


class Pieces:
    """The vocabulary's pieces that words can be made of: lower-case letters and non-ASCII bytes, perhaps after a blank, and every
    single byte, so that each word has a segmentation. Looked up by a hash of the bytes, per length."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
        fits = {p for p in pieces if len(p) <= LONGEST_PIECE and re.fullmatch(rb" ?[a-z\x80-\xff]+", p)}
        self.pieces = sorted(fits | {bytes([b]) for b in range(256)})
        self.by_length = []
        for k in range(1, LONGEST_PIECE + 1):
            of_k = [i for i, p in enumerate(self.pieces) if len(p) == k]
            raw = np.frombuffer(b"".join(self.pieces[i] for i in of_k), np.uint8).reshape(-1, k)
            hashes = self._rolled(raw) if len(of_k) else np.zeros(0, np.uint64)
            order = np.argsort(hashes)
            self.by_length.append((hashes[order], np.array(of_k, np.int64)[order]))

    def __len__(self) -> int:
        return len(self.pieces)

    @staticmethod
    def _rolled(raw: np.ndarray) -> np.ndarray:
        h = np.zeros(len(raw), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(raw.shape[1]):
                h = (h ^ (raw[:, i].astype(np.uint64) + np.uint64(1))) * _MULTIPLIER
                h ^= h >> np.uint64(29)
        return h

    def found(self, flat: np.ndarray) -> np.ndarray:
        """For each place in the bytes and each length: the piece that begins there, or len(self)."""
        out = np.full((len(flat), LONGEST_PIECE), len(self), np.int32)
        h = np.zeros(len(flat), np.uint64)
        with np.errstate(over="ignore"):
            for k, (hashes, ids) in enumerate(self.by_length):
                n = len(flat) - k
                if n <= 0 or not len(hashes):
                    break
                h = (h[:n] ^ (flat[k:].astype(np.uint64) + np.uint64(1))) * _MULTIPLIER
                h ^= h >> np.uint64(29)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[at] == h
                out[:n][hit, k] = ids[at[hit]]
        return out


def _blocks(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(order, lengths, flat bytes) of runs of words, longest first."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-lengths, kind="stable")
    for a in range(0, len(order), _BLOCK):
        part = order[a : a + _BLOCK]
        yield part, lengths[part], np.frombuffer(b"".join(words[i] for i in part), np.uint8)


def _forward(pieces: Pieces, probability: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all segmentations of each word's first i bytes; found pieces; words' starts. ``probability``: pieces + a zero row, by language."""
    found, starts = pieces.found(flat), np.cumsum(lengths) - lengths
    sums = np.zeros((int(lengths[0]) + 1, len(lengths), probability.shape[1]))
    sums[0] = 1
    for i in range(1, int(lengths[0]) + 1):
        live = int(np.searchsorted(-lengths, -i, side="right"))  # words of at least i bytes stand first
        for k in range(1, min(i, LONGEST_PIECE) + 1):
            sums[i, :live] += sums[i - k, :live] * probability[found[starts[:live] + i - k, k - 1]]
    return sums, found, starts


def word_scores(pieces: Pieces, probability: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log probability of each word in each language, over all segmentations."""
    out = np.zeros((len(words), probability.shape[1]))
    for part, lengths, flat in _blocks(words):
        sums, _, _ = _forward(pieces, probability, lengths, flat)
        out[part] = np.log(np.maximum(sums[lengths, np.arange(len(part))], 1e-300))
    return out


def expected_uses(pieces: Pieces, probability: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the counted words under one language's probabilities."""
    total = np.zeros(len(pieces) + 1)
    for part, lengths, flat in _blocks(words):
        sums, found, starts = _forward(pieces, probability[:, None], lengths, flat)
        sums, n, most = sums[:, :, 0], counts[part], int(lengths[0])
        whole = np.maximum(sums[lengths, np.arange(len(part))], 1e-300)
        back = np.zeros((most + 1, len(part)))
        back[lengths, np.arange(len(part))] = 1
        for i in range(most - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -(i + 1), side="right"))
            for k in range(1, min(most - i, LONGEST_PIECE) + 1):
                enough = int(np.searchsorted(-lengths, -(i + k), side="right"))
                which = found[starts[:enough] + i, k - 1]
                through = probability[which] * back[i + k, :enough]
                back[i, :enough] += through
                total += np.bincount(which, sums[i, :enough] * through / whole[:enough] * n[:enough], minlength=len(total))
            del live
    return total[:-1]


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over all rows with a language; words counted in each task, then summed."""
    plain = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("t"))

    def run(batches):
        held: dict[str, Counter] = {}

        def rows():
            for name, counter in held.items():
                if counter:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "lang": pa.array([name] * len(counter), pa.string()),
                            "word": pa.array(list(counter), pa.binary()),
                            "n": pa.array(list(counter.values()), pa.int64()),
                        }
                    )
            held.clear()

        for batch in batches:
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("t")):
                counter = held.setdefault(name, Counter())
                counter.update(words_of(t.as_py()))
            if sum(map(len, held.values())) > 2 * _KEEP:
                yield from _cut_words(rows())
        yield from _cut_words(rows())

    return plain.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, words, counts = [], [], []
        for name, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            for piece in _cut(word.decode("utf-8", "surrogatepass")):
                langs.append(name), words.append(piece), counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])


class LanguageModel:
    """Languages in ascending order and their piece probabilities (pieces and a zero row, by language)."""

    def __init__(self, languages: list[str], probability: np.ndarray, vocabulary: str):
        self.languages, self.probability, self.vocabulary = languages, probability, vocabulary


def fit(docs: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", rounds: int = 2, smoothing: float = 0.05) -> LanguageModel:
    """Learns from every row of ``docs`` with a non-null language. The number of languages is that of the labels' distinct values, each a
    column of the model."""
    counts = materialize(word_counts(docs, text, lang), "words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    size = len(_pieces(vocabulary))
    probability = np.full((size + 1, max(1, len(languages))), 1 / size)
    probability[-1] = 0
    spark = docs.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(probability)  # vocabulary times languages

        def expect(batches, shared=shared):
            total = np.zeros((size, len(languages)))
            pieces = None
            for batch in batches:
                pieces = pieces or _pieces(vocabulary)
                names = np.array(batch.column("lang").to_pylist(), object)
                words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(np.float64)
                for j, name in enumerate(languages):
                    mine = np.flatnonzero(names == name)
                    if len(mine):
                        total[:, j] += expected_uses(pieces, shared.value[:, j], [words[i] for i in mine], n[mine])
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int64()), "language": pa.array(language, pa.int64()), "uses": pa.array(total[piece, language])})

        uses = counts.mapInArrow(expect, "piece long, language long, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses"))
        new = np.full_like(probability, smoothing)
        for r in uses.collect():  # a row per piece and language at most
            new[r["piece"], r["language"]] += r["uses"]
        new[-1] = 0
        probability = new / new.sum(axis=0)
    return LanguageModel(languages, probability, vocabulary)


class _Scorer:
    """Scores words with a model and remembers about ``_KEEP`` of them from one list of texts to the next."""

    def __init__(self, model: LanguageModel):
        self.model, self.pieces = model, _pieces(model.vocabulary)
        self._reset()

    def _reset(self):
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.number) > _KEEP:
            self._reset()
        number, fresh, rows = self.number, [], []
        for t in texts:
            row = []
            for w in words_of(t):
                at = number.get(w)
                if at is None:
                    at = number[w] = len(number)
                    fresh.append(w)
                row.append(at)
            rows.append(row)
        if fresh:
            parts = [_cut(w) for w in fresh]
            flat = word_scores(self.pieces, self.model.probability, [p for ps in parts for p in ps])
            at = np.concatenate(([0], np.cumsum([len(ps) for ps in parts])[:-1]))
            self.scores = np.concatenate([self.scores, np.add.reduceat(flat, at, axis=0)])
        names, chances = [], []
        for row in rows:
            if not row:
                names.append("und"), chances.append(0.0)
                continue
            total = self.scores[row].sum(axis=0)
            likely = np.exp(total - total.max())
            best = int(total.argmax())
            names.append(self.model.languages[best])
            chances.append(float(likely[best] / likely.sum()))
        return names, chances


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", extra: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row: the likeliest language of the whole text under even priors, and its
    posterior probability. ``extra`` fills held_out. A null text, or one without a letter, is ``und`` with score 0, as
    is every text under a model without languages. Ties go to the first language by name. Nothing but the text is looked at."""
    extra = F.lit(False) if extra is None else extra
    plain = docs.select(F.col(key).alias("doc_id"), extra.alias("held_out"), F.col(text).cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages

    def run(batches):
        scorer = None
        for batch in batches:
            scorer = scorer or _Scorer(shared.value)
            texts = batch.column("t").to_pylist()
            for a, b in slices(texts):
                names, chances = scorer.texts(texts[a:b]) if shared.value.languages else (["und"] * (b - a), [0.0] * (b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(names, pa.string()), pa.array(chances, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
