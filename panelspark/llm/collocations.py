"""Phrases whose words occur together more often than apart, from exact counts of all runs of up to four words.

Counting is level by level, as a rare part rules a phrase out. Words are counted first. Then pairs of frequent words, and triples of frequent pairs, are
counted by a digest of 48 bits: what a digest stands for is at most as frequent as the digest. Phrases themselves are counted last, where all their
pairs and triples are such. Frequent words, pairs and triples reach the tasks as filters of a fixed size that may let rare ones through, never the other way, so counts stay exact
whatever the corpus' size.

In a task phrases are counted in a burst trie: the first word's number leads to a hash container of the remaining words' numbers; a container
that grows past a bound bursts into a node with a container for each next word. When a task holds too many phrases, the largest subtrees
of first words are written as sorted runs and forgotten. Runs are dealt by the digest of a phrase's first three words and merged there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

BITS = 20  # of a word's number inside a task
_MASK = (1 << BITS) - 1
HELD = 600_000  # phrases that a task holds before it writes runs; no effect on results
BURST = 4096  # entries of a container before it bursts; no effect on results
WAITING = 1 << 22  # pairs that a task holds before it writes a run; no effect on results
BUCKET = 1 << 21  # pairs that are merged at a time, about; no effect on results
DIGEST = 48  # bits of a pair's digest; no effect on results
FILTER = 1 << 20  # blocks of 64 bits of a filter (8 MB); no effect on results
_PART = 1 << 21  # bytes of text that are split at a time
_PREFIX = 3
_BREAK = b"\xff"  # occurs in no UTF-8 text
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_RUNS = "lang string, prefix long, size int, phrase string, n long"


# The filter of frequent phrases ---------------------------------------------------------------------------------------


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\x00" + word, 42)


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs of two words from the words' own."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits (four of 64) of each hash."""
    bits = np.zeros(len(h), np.uint64)
    for i in range(4):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return ((h >> np.uint64(24)) % np.uint64(blocks)).astype(np.int64), bits


class Filter:
    """Tells which hashes may be among the frequent ones; wrong only by letting others through."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        at, bits = _places(h, len(self.blocks))
        return (self.blocks[at] & bits) == bits


def filter_of(frequent: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], blocks: int) -> Filter:
    """The filter of a table's rows by their hashes. Blocks are joined by an aggregate; the driver gets ``blocks`` rows at most."""

    def run(batches):
        mine = np.zeros(blocks, np.uint64)
        for batch in batches:
            if batch.num_rows:
                at, bits = _places(hashes(batch), blocks)
                np.bitwise_or.at(mine, at, bits)
        used = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(mine[used].view(np.int64))], names=["at", "bits"])

    found = frequent.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(blocks, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filter(out)


def word_filter(words: DataFrame, blocks: int) -> Filter:
    """The filter of (lang, phrase), phrases being single words."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        rows = zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
        return np.array([word_hash(lang.encode(), w.encode()) for lang, w in rows], np.uint64)

    return filter_of(words.select("lang", "phrase"), hashes, blocks)


def _mixed(digests: np.ndarray) -> np.ndarray:
    """Hashes of digests."""
    with np.errstate(over="ignore"):
        h = digests * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def digest_filter(digests: DataFrame, blocks: int) -> Filter:
    return filter_of(digests.select("digest"), lambda batch: _mixed(batch.column("digest").to_numpy().view(np.uint64)), blocks)


# The trie -------------------------------------------------------------------------------------------------------------


class _Node(dict):
    """Next word's number to a container or a node."""


class BurstTrie:
    """Counts of phrases as word numbers: the first word's, and up to three more packed in one integer, high bits first, zero where the phrase has
    ended. Containers are plain dicts; one with more than ``burst`` entries becomes a node."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.sizes = burst, _Node(), Counter()

    def add(self, first: np.ndarray, rest: np.ndarray, n: np.ndarray) -> None:
        """Adds counts of distinct phrases in ascending order of (first, rest)."""
        if not len(first):
            return
        starts = np.concatenate(([0], np.flatnonzero(first[1:] != first[:-1]) + 1)).tolist()
        heads, rest, n = first[starts].tolist(), rest.tolist(), n.tolist()
        for head, a, b in zip(heads, starts, [*starts[1:], len(rest)]):
            self.root[head], grown = self._into(self.root.get(head), 2 * BITS, rest[a:b], n[a:b])
            self.sizes[head] += grown

    def _into(self, child: dict | None, shift: int, keys: list[int], n: list[int]) -> tuple[dict, int]:
        """The child with the counts added, and the number of new phrases; ``shift`` is the place of the keys' first word."""
        if isinstance(child, _Node):
            grown, a, low = 0, 0, (1 << shift) - 1
            while a < len(keys):
                word, b = keys[a] >> shift, a + 1
                while b < len(keys) and keys[b] >> shift == word:
                    b += 1
                child[word], more = self._into(child.get(word), shift - BITS, [k & low for k in keys[a:b]], n[a:b])
                grown, a = grown + more, b
            return child, grown
        container = {} if child is None else child
        before, get = len(container), container.get
        for k, m in zip(keys, n):
            container[k] = get(k, 0) + m
        grown = len(container) - before
        if len(container) > self.burst and shift > 0:
            node, low = _Node(), (1 << shift) - 1
            for k, m in container.items():
                node.setdefault(k >> shift, {})[k & low] = m
            return node, grown
        return container, grown

    def __len__(self) -> int:
        return self.sizes.total()

    def _walk(self, child: dict, shift: int, high: int) -> Iterator[tuple[int, int]]:
        if isinstance(child, _Node):
            for word, below in child.items():
                yield from self._walk(below, shift - BITS, high | word << shift)
        else:
            for k, m in child.items():
                yield high | k, m

    def take(self, head: int) -> list[tuple[int, int]]:
        """(rest, n) of the phrases that begin with a word; the subtree is forgotten."""
        del self.sizes[head]
        return list(self._walk(self.root.pop(head), 2 * BITS, 0))

    def largest(self, keep: int) -> list[int]:
        """First words of the largest subtrees, so many that at most ``keep`` phrases stay."""
        out, left = [], len(self)
        for head, size in self.sizes.most_common():
            if left <= keep:
                break
            out.append(head)
            left -= size
        return out


# Counting in a task ---------------------------------------------------------------------------------------------------


def parts_of(text: bytes, size: int = _PART) -> Iterator[list[bytes]]:
    """Words and breaks of lower-cased text in order, as lists for about ``size`` bytes each; ends with a break."""
    data, at = text.translate(_SPLIT), 0
    while at < len(data):
        end = data.find(b" ", at + size) if at + size < len(data) else len(data)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(_BREAK, b" \xff ").split(b" ")
        at = end
    yield [_BREAK]


class _Numbers(dict):
    """Numbers of a language's words; zero for a break."""

    def __init__(self):
        super().__init__({b"": -1, _BREAK: 0})
        self.text = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.text)
        self.text.append(word)
        return number


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, inverse.reshape(-1)


def _digests(hashes: np.ndarray, *numbers: np.ndarray) -> np.ndarray:
    """Digests of runs of two or three words, given by their numbers."""
    h = hashes[numbers[0]]
    for x in numbers[1:]:
        h = pair_hashes(h, hashes[x])
    return h >> np.uint64(64 - DIGEST)


def pair_digests(x: np.ndarray, seen: int, hashes: np.ndarray) -> np.ndarray:
    """Digests of runs of two numbers that end behind the first ``seen`` places."""
    at = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
    at = at[at + 1 >= seen]
    return _digests(hashes, x[at], x[at + 1])


def _pairs_of(x: np.ndarray, hashes: np.ndarray, pairs: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers that may be frequent, in ascending order as packed keys; at each place the number of the pair that begins there, or -1;
    and the places of the good ones."""
    at = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
    keys, inverse = _unique(x[at] << BITS | x[at + 1])
    good = pairs.may_hold(_mixed(_digests(hashes, keys >> BITS, keys & _MASK)))
    number = np.cumsum(good) - 1
    pair = np.full(len(x), -1, np.int64)
    at, inverse = at[good[inverse]], inverse[good[inverse]]
    pair[at] = number[inverse]
    return keys[good], pair, at


def triple_digests(x: np.ndarray, seen: int, hashes: np.ndarray, pairs: Filter) -> np.ndarray:
    """Digests of runs of three numbers, both of whose pairs may be frequent, that end behind the first ``seen`` places."""
    _, pair, _ = _pairs_of(x, hashes, pairs)
    at = np.flatnonzero((pair[:-2] >= 0) & (pair[1:-1] >= 0))
    at = at[at + 2 >= seen]
    return _digests(hashes, x[at], x[at + 1], x[at + 2])


def phrases_of(x: np.ndarray, seen: int, hashes: np.ndarray, pairs: Filter, triples: Filter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, rest, n) of runs of two, three and four numbers all of whose pairs and triples may be frequent."""
    keys, pair, at = _pairs_of(x, hashes, pairs)
    n = np.bincount(pair[at[at + 1 >= seen]], minlength=len(keys))
    some = n > 0
    yield keys[some] >> BITS, (keys[some] & _MASK) << 2 * BITS, n[some]

    at = np.flatnonzero((pair[:-2] >= 0) & (pair[1:-1] >= 0))
    threes, inverse = _unique(pair[at] << BITS | x[at + 2])
    first, second, third = keys[threes >> BITS] >> BITS, keys[threes >> BITS] & _MASK, threes & _MASK
    good = triples.may_hold(_mixed(_digests(hashes, first, second, third)))
    n = np.bincount(inverse[at + 2 >= seen], minlength=len(threes))
    rest, some = second << 2 * BITS | third << BITS, good & (n > 0)
    yield first[some], rest[some], n[some]

    three = np.full(len(x), -1, np.int64)
    three[at] = np.where(good[inverse], inverse, -1)
    at = np.flatnonzero((three[:-3] >= 0) & (three[1:-2] >= 0))
    at = at[at + 3 >= seen]
    fours, n = np.unique(three[at] << BITS | x[at + 3], return_counts=True)
    yield first[fours >> BITS], rest[fours >> BITS] | fours & _MASK, n


class _Language:
    """Numbers and trie of a language inside a task."""

    def __init__(self, lang: str, words: Filter, burst: int = BURST):
        self.lang, self.words = lang.encode(), words
        self.numbers, self.trie = _Numbers(), BurstTrie(burst)
        self.hashes, self.often = np.zeros(1, np.uint64), np.zeros(1, bool)

    def _numbered(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words in order; zero where a phrase cannot go on."""
        x = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        fresh = self.numbers.text[len(self.hashes) :]
        if fresh:
            new = np.array([word_hash(self.lang, w) for w in fresh], np.uint64)
            self.hashes, self.often = np.concatenate([self.hashes, new]), np.concatenate([self.often, self.words.may_hold(new)])
        x = x[x >= 0]
        return np.where(self.often[x], x, 0)

    def parts(self, text: bytes) -> Iterator[tuple[np.ndarray, int]]:
        """Numbers of the text part by part, and how many of them were in the part before."""
        carried = np.zeros(0, np.int64)
        for words in parts_of(text):
            x = np.concatenate([carried, self._numbered(words)])
            yield x, len(carried)
            carried = x[-3:]

    def count(self, text: bytes, pairs: Filter, triples: Filter) -> None:
        for x, seen in self.parts(text):
            for found in phrases_of(x, seen, self.hashes, pairs, triples):
                self.trie.add(*found)

    def run_of(self, head: int) -> list[tuple[bytes, int, int]]:
        """(phrase, words, n) of a first word's subtree, sorted by phrase."""
        text, out = self.numbers.text, []
        for rest, n in self.trie.take(head):
            words = [head, rest >> 2 * BITS, rest >> BITS & _MASK, rest & _MASK]
            words = [text[w] for w in words if w]
            out.append((b" ".join(words), len(words), n))
        return sorted(out)


def _batch(lang: str, run: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    prefixes = [xxhash.xxh64_intdigest(b" ".join(p.split(b" ")[:_PREFIX]), 42) for p, _, _ in run]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(run), pa.string()),
            pa.array(np.array(prefixes, np.uint64).view(np.int64)),
            pa.array([m for _, m, _ in run], pa.int32()),
            pa.array([p for p, _, _ in run], pa.binary()).cast(pa.string()),
            pa.array([n for _, _, n in run], pa.int64()),
        ],
        names=["lang", "prefix", "size", "phrase", "n"],
    )


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, text): the texts of a batch, those of a language one after another with breaks between."""
    texts: dict[str, list[bytes]] = {}
    for lang, t in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist()):
        texts.setdefault(lang, []).append(t.encode("utf-8", "surrogatepass"))
    for lang, parts in texts.items():
        yield lang, b"\n".join(parts)


def word_runs(plain: DataFrame, held: int) -> DataFrame:
    """Runs of single words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def spill() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                words = sorted(w for w in found if w and w != _BREAK)
                for i in range(0, len(words), 50_000):
                    yield _batch(lang, [(w, 1, found[w]) for w in words[i : i + 50_000]])
            counts.clear()

        for batch in small_batches(batches, "t"):
            for lang, text in _by_language(batch):
                for words in parts_of(text):
                    counts.setdefault(lang, Counter()).update(words)
                    if sum(map(len, counts.values())) >= held:
                        yield from spill()
        yield from spill()

    return plain.mapInArrow(run, _RUNS)


_PAIRS = "bucket int, digests binary, counts binary"
_BYTES = DIGEST // 8


def digest_runs(plain: DataFrame, words: Filter, pairs: Filter | None, bits: int, held: int) -> DataFrame:
    """Sorted runs of pairs' digests, or, given the frequent pairs, of triples', with their counts, cut by their first ``bits`` bits."""
    context = plain.sparkSession.sparkContext
    shared, shared_pairs = context.broadcast(words), None if pairs is None else context.broadcast(pairs)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, _Language] = {}
        waiting: list[np.ndarray] = []

        def spill() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            bucket = (found >> np.uint64(DIGEST - bits)).astype(np.int32)
            starts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)) if len(found) else np.zeros(0, np.int64)
            low = found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]
            spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(found)]))
            for i in range(0, len(spans), 4096):
                part = spans[i : i + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[[a for a, _ in part]]),
                        pa.array([low[a:b].tobytes() for a, b in part], pa.binary()),
                        pa.array([n[a:b].astype("<u4").tobytes() for a, b in part], pa.binary()),
                    ],
                    names=["bucket", "digests", "counts"],
                )

        for batch in small_batches(batches, "t"):
            for lang, text in _by_language(batch):
                state = langs.setdefault(lang, _Language(lang, shared.value))
                for x, seen in state.parts(text):
                    known = (x, seen, state.hashes)
                    waiting.append(pair_digests(*known) if shared_pairs is None else triple_digests(*known, shared_pairs.value))
                    if sum(map(len, waiting)) >= held:
                        yield from spill()
                if sum(len(x.numbers) for x in langs.values()) >= _MASK // 2:
                    langs.clear()
        if waiting:
            yield from spill()

    return plain.mapInArrow(run, _PAIRS)


def frequent_digests(runs: DataFrame, least: int) -> DataFrame:
    """(digest) of the digests that are counted ``least`` times or more; the runs of a bucket are merged in one task."""

    def merge(group: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(group.column("digests").to_pylist()), np.uint8).reshape(-1, _BYTES)
        n = np.frombuffer(b"".join(group.column("counts").to_pylist()), "<u4").astype(np.int64)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :_BYTES] = raw
        found = wide.reshape(-1).view("<u8")
        order = np.argsort(found, kind="stable")  # nearly free on runs that are sorted
        found, n = found[order], n[order]
        starts = np.concatenate(([0], np.flatnonzero(found[1:] != found[:-1]) + 1))
        total = np.add.reduceat(n, starts)
        return pa.table({"digest": pa.array(found[starts][total >= least].view(np.int64))})

    return runs.groupBy("bucket").applyInArrow(merge, "digest long")


def phrase_runs(plain: DataFrame, words: Filter, pairs: Filter, triples: Filter, held: int, burst: int) -> DataFrame:
    """Sorted runs of phrases of two to four words, with their counts."""
    context = plain.sparkSession.sparkContext
    shared, parts = context.broadcast(words), context.broadcast((pairs, triples))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, _Language] = {}

        def spill(keep: int) -> Iterator[pa.RecordBatch]:
            total = sum(len(x.trie) for x in langs.values())
            for lang, state in langs.items():
                share = keep * len(state.trie) // max(total, 1)
                heads = sorted(state.trie.largest(share), key=state.numbers.text.__getitem__)
                pending: list[tuple[bytes, int, int]] = []
                for head in heads:
                    pending += state.run_of(head)
                    if len(pending) >= 20_000:
                        yield _batch(lang, pending)
                        pending = []
                if pending:
                    yield _batch(lang, pending)

        for batch in small_batches(batches, "t"):
            for lang, text in _by_language(batch):
                langs.setdefault(lang, _Language(lang, shared.value, burst)).count(text, *parts.value)
                if sum(len(x.trie) for x in langs.values()) >= held:
                    yield from spill(held // 2)
                if sum(len(x.numbers) for x in langs.values()) >= _MASK // 2:
                    yield from spill(0)
                    langs.clear()
        yield from spill(0)

    return plain.mapInArrow(run, _RUNS)


# The whole ------------------------------------------------------------------------------------------------------------


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """The phrases of runs that occur ``least`` times or more; runs are dealt by their phrases' prefix."""
    summed = runs.repartition("prefix").groupBy("prefix", "lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return summed.where(F.col("n") >= least).drop("prefix")


def count_phrases(
    docs: DataFrame, lang: str, text: str, least: int, held: int = HELD, burst: int = BURST, blocks: int = FILTER, waiting: int = WAITING
) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of the runs of 1 to 4 words that occur ``least`` times or more in their language, and (lang, n) of all words."""
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    runs = materialize(word_runs(plain, held), "words")
    totals = materialize(runs.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = materialize(_merged(runs, least), "frequent")
    often = word_filter(words, blocks)
    occurrences = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(8, (occurrences // BUCKET).bit_length())  # no bucket has many more than BUCKET pairs
    pairs = digest_filter(materialize(frequent_digests(digest_runs(plain, often, None, bits, waiting), least), "pairs"), blocks)
    triples = digest_filter(materialize(frequent_digests(digest_runs(plain, often, pairs, bits, waiting), least), "triples"), blocks)
    more = materialize(_merged(phrase_runs(plain, often, pairs, triples, held, burst), least), "frequent")
    return words.unionByName(more), totals


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, inside: int = 80, top: int = 2000, salts: int = 64,
    held: int = HELD, burst: int = BURST, blocks: int = FILTER, waiting: int = WAITING,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 4 words.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, those at blanks and tabs into words. n is the number of the language's
    words. A phrase that occurs a >= ``least`` times is a candidate; cut after its first k words, it scores floor(2000000 * a / (l + r)), l and r being
    how often the two parts occur; the cut of the lowest score counts, the smallest k if several have it. A candidate goes if a longer one
    that holds its words in a row occurs at least ``inside`` hundredths as often, whether that one stays or not. Ranks go by falling score, falling
    a, and the phrase's bytes.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they occur; very long texts are split in parts that carry the
    last words over; an empty table gives an empty result. Other columns of ``docs`` are not read, whatever their names.
    """
    found, totals = count_phrases(docs, lang, text, least, held, burst, blocks, waiting)
    words = F.split("phrase", " ")
    candidates = found.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), words.alias("words"))

    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    part = [F.array_join(F.slice("words", 1, F.col("k")), " "), F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ")]
    cuts = candidates.select("lang", "phrase", "a", "size", "words", cut).select("lang", "phrase", "a", "k", part[0].alias("left"), part[1].alias("right"))
    left = found.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = found.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    exact = F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)"), F.col("l").cast("decimal(20,0)") + F.col("r"))
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))

    def inner(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.col("size") - size + 1)
        return F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(size)), " "))

    shorter = F.when(F.col("size") == 3, inner(2)).otherwise(F.concat(inner(2), inner(3)))
    within = candidates.where("size > 2").select("lang", "a", F.explode(shorter).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * inside
    kept = lowest.join(within, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = flat.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.drop("salt", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
