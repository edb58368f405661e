"""Which terms and which other sources a source differs from most, by late materialization of the terms' strings.

Tasks count terms where the text lies and write (lang, source, digest, counts, term). All counting after that shuffles
digests of eight bytes only. Strings are read again for the digests that are kept: the smallest and the largest string of a digest
tell whether several terms share it; such digests are counted once more by (digest, number of the term), so that no count mixes two
terms. The strings join the results last, for the rows that are returned.

The sum over all kept terms of a pair of sources is taken from the occurring counts alone: a term that neither, only one, or both
sources use adds one of four values, of which three depend on one source's count or on none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

HELD = 400_000  # about as many distinct (lang, source, term) does a task count at a time, from texts of 16 bytes each; no effect on results
_PART = 1 << 20  # bytes of a text that are split at a time
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ROWS = "lang string, source string, digest long, n long, docs long, term string, lead boolean"


def term_digest(term: bytes) -> int:
    """XXH64 as a signed long."""
    digest = xxhash.xxh64_intdigest(term, 42)
    return digest - (1 << 64) if digest >> 63 else digest


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order: runs of ASCII letters (A-Z lower-cased) and non-ASCII characters; a list for each part of a long text."""
    data = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _PART) if at + _PART < len(data) else len(data)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _long_text(batch: pa.RecordBatch, digest: Callable[[bytes], int]) -> Iterator[pa.RecordBatch]:
    """The rows of one text, which is split part by part."""
    counts = Counter(chain.from_iterable(terms_of(batch.column("t")[0].as_py())))
    terms = list(counts)
    digests, n = [digest(t) for t in terms], np.fromiter(counts.values(), np.int64, len(terms))
    at = pa.array(np.zeros(len(terms), np.int64))
    lang, source, ones = batch.column("lang").take(at), batch.column("source").take(at), np.ones_like(n)
    yield from _in_slices(lang, source, digests, n, ones, pa.array(terms, pa.binary()).cast(pa.string()), ones.astype(bool))


def _counted_texts(texts: pa.Table, digest: Callable[[bytes], int]) -> Iterator[pa.RecordBatch]:
    """The rows of several texts: Arrow splits them and numbers their terms, and sorted numbers are counted."""
    lang, source = (texts[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    width = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
    plain = [t.encode("utf-8", "surrogatepass").translate(_TERM_BYTES) for t in texts["t"].to_pylist()]
    split = pc.ascii_split_whitespace(pa.array(plain, pa.large_binary()).cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    terms, code, text = coded.dictionary, coded.indices.to_numpy().astype(np.int64), pc.list_parent_indices(split).to_numpy()
    empty = pc.index(terms, "").as_py()
    if empty >= 0:  # blanks at the ends of a text
        code, text = code[code != empty], text[code != empty]
    all_terms = max(len(terms), 1)
    of_text, times = np.unique(text * all_terms + code, return_counts=True)
    key = group[of_text // all_terms] * all_terms + of_text % all_terms
    order = np.argsort(key, kind="stable")
    found, starts, texts_with = np.unique(key[order], return_index=True, return_counts=True)
    n = np.add.reduceat(times[order], starts) if len(starts) else times
    which, at = found // all_terms, pa.array(found % all_terms)
    digests = np.array([digest(t) for t in terms.cast(pa.large_binary()).to_pylist()], np.int64)
    lead = np.zeros(len(found), bool)
    lead[np.unique(found % all_terms, return_index=True)[1]] = True
    lang, source = lang.dictionary.take(pa.array(which // width)), source.dictionary.take(pa.array(which % width))
    yield from _in_slices(lang, source, digests[found % all_terms], n, texts_with, terms.take(at).cast(pa.string()), lead)


def _in_slices(lang: pa.Array, source: pa.Array, digests: Sequence[int], n: np.ndarray, docs: np.ndarray, term: pa.Array, lead: np.ndarray) -> Iterator[pa.RecordBatch]:
    columns = [lang, source, pa.array(digests, pa.int64()), pa.array(n, pa.int64()), pa.array(docs, pa.int64()), term, pa.array(lead)]
    rows = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "digest", "n", "docs", "term", "lead"])
    for i in range(0, len(term), 50_000):
        yield rows.slice(i, 50_000)


def term_rows(docs: DataFrame, lang: str, source: str, text: str, digest: Callable[[bytes], int], held: int) -> DataFrame:
    """(lang, source, digest, n, docs, term, lead): occurrences, and texts that have the term, summed over the texts that a task holds at a time. ``lead`` is
    true in one row of each term of these texts."""
    columns = ((lang, "lang"), (source, "source"), (text, "t"))
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in columns])

    size = 16 * held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, waits = [], 0
        for batch in small_batches(batches, "t", size):
            length = pc.sum(pc.binary_length(batch.column("t"))).as_py()
            if batch.num_rows == 1 and length > size:
                yield from _long_text(batch, digest)
                continue
            waiting.append(batch)
            waits += length
            if waits >= size:
                yield from _counted_texts(pa.Table.from_batches(waiting).combine_chunks(), digest)
                waiting, waits = [], 0
        if waiting:
            yield from _counted_texts(pa.Table.from_batches(waiting).combine_chunks(), digest)

    return plain.mapInArrow(run, _ROWS)


def _counted(rows: DataFrame, least: int) -> DataFrame:
    """(lang, digest, part, n, per): the terms of a language that at least ``least`` of its texts have; ``per`` lists each source that uses
    the term with its count. One shuffle."""
    of_source = rows.repartition("lang", "digest").groupBy("lang", "digest", "part", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per = F.collect_list(F.struct("source", "n")).alias("per")  # no longer than the list of the language's sources
    return of_source.groupBy("lang", "digest", "part").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), per).where(F.col("docs") >= least).drop("docs")


def kept_terms(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The kept terms of ``rows`` (a written table) as ``_counted`` has them, and (digest, part, term): what their digests stand for.

    A digest that several terms share has at least the texts of each of them, so no kept term is lost before it is split. ``part`` is 0 but for
    such digests, where it numbers their terms.
    """
    plain = rows.select("lang", "source", "digest", F.lit(0).alias("part"), "n", "docs")
    counted = materialize(_counted(plain, least), "digests")
    wanted = counted.select("digest")
    spelled = rows.where("lead").select("digest", "term").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
    spelled = materialize(spelled, "spelled")
    single = spelled.where("lo = hi").select("digest", F.lit(0).alias("part"), F.col("lo").alias("term"))
    shared = spelled.where("lo <> hi").select("digest")
    if shared.isEmpty():
        return counted, single
    mixed = materialize(rows.join(shared, "digest", "left_semi"), "mixed")
    numbers = mixed.groupBy("digest").agg(F.array_sort(F.collect_set("term")).alias("terms")).select("digest", F.posexplode("terms").alias("part", "term"))
    numbers = materialize(numbers, "numbers")
    split = mixed.join(numbers, ["digest", "term"]).select("lang", "source", "digest", "part", "n", "docs")
    kept = counted.join(shared, "digest", "left_anti").unionByName(_counted(split, least))
    return materialize(kept, "kept"), materialize(single.unionByName(numbers), "spelling")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)), three decimal digits at a time where the product may pass 64 bits. A total of more than 9 * 10**15 is
    an error then."""
    whole = F.greatest(total + terms, F.lit(1))
    rest, found = n + 1, F.lit(0).cast("long")
    for _ in range(3):
        found = found * 1000 + F.call_function("div", rest * 1000, whole)
        rest = rest * 1000 % whole
    short = F.call_function("div", (n + 1) * 1_000_000_000, whole)
    return F.when(n < 9_000_000_000, short).otherwise(found) + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); p and q are at most 10**9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 3, top: int = 200,
    digest: Callable[[bytes], int] = term_digest, held: int = HELD,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    A language keeps the V terms that at least ``least`` of its texts have. Every group, and each language as a whole, gives each kept term the smoothed
    share p = 1 + floor(10**9 * (count + 1) / (N + V)), N being its count of kept terms. The value of p against q is floor((p - q)**2 / q).
    Part ``pair`` has each other source of the language as item and the values against its shares summed over all kept terms; part ``term`` the kept
    terms that the group uses more than its language, by their value, ``top`` ranks at most. Ranks go by falling value, then by the item's bytes.

    Null texts, languages and sources are empty ones; a group without terms, or whose language keeps none, has a pair row of value 0 for each other source of
    such a language; empty texts count as texts without terms; repeated rows count as often as they occur; very long texts are split in parts; an empty table
    gives an empty result. Other columns of ``docs`` are not read, whatever their names.
    """
    rows = materialize(term_rows(docs, lang, source, text, digest, held), "terms")
    kept, spelling = kept_terms(rows, least)
    used = kept.select("lang", "digest", "part", F.col("n").alias("n_lang"), F.inline("per").alias("source", "n"))

    name = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]
    groups = docs.select(*name).distinct()
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    known = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    stats = materialize(known.na.fill(0, ["total", "terms", "lang_total"]), "stats")

    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))
    shares = used.join(stats, ["lang", "source"]).select("lang", "source", "digest", "part", p.alias("p"), q.alias("q")).where("p > q")
    scored = shares.select("lang", "source", "digest", "part", _gap(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    last = scored.select("lang", "source", "value", F.row_number().over(best).alias("k")).where(F.col("k") <= top)
    last = materialize(last.groupBy("lang", "source").agg(F.min("value").alias("least")), "last")
    chosen = scored.join(last, ["lang", "source"]).where("value >= least").join(spelling, ["digest", "part"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = chosen.select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    pairs = _pairs(used, kept, stats).withColumn("rank", F.row_number().over(order))
    result = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return result.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _common(kept: DataFrame, side: DataFrame) -> DataFrame:
    """(lang, source, item, value): what the terms that both sources of a pair use add to its sum beyond their parts in the sums over each source's own
    terms. A pair is met once and answers for both directions; its parts are sums of longs, the upper and the lower bits apart, and meet in the tasks first."""
    a = side.select("lang", "source", F.col("total").alias("total_a"), "terms", F.col("zero").alias("zero_a"))
    b = side.select("lang", F.col("source").alias("item"), F.col("total").alias("total_b"), F.col("zero").alias("zero_b"))
    first = kept.where(F.size("per") > 1).select("lang", F.inline("per").alias("source", "n_a"), "per").join(a, ["lang", "source"])
    first = first.select("lang", "source", "terms", "zero_a", _share(F.col("n_a"), F.col("total_a"), F.col("terms")).alias("p"), "per")
    later = F.filter("per", lambda x: x["source"] > F.col("source"))
    met = first.withColumn("per", later).select("lang", "source", "terms", "zero_a", "p", F.inline("per").alias("item", "n_b")).join(b, ["lang", "item"])
    met = met.withColumn("q", _share(F.col("n_b"), F.col("total_b"), F.col("terms")))

    def beyond(p: str, q: str, zero_p: str, zero_q: str) -> Column:
        """What a term adds, but for the value of the two zero shares, which is the same for all terms of a pair."""
        p, q, zero_p, zero_q = F.col(p), F.col(q), F.col(zero_p), F.col(zero_q)
        return _gap(p, q) - _gap(p, zero_q) - _gap(zero_p, q)

    pair = ["lang", "source", "item", "zero_a", "zero_b"]
    met = met.select(*pair, beyond("p", "q", "zero_a", "zero_b").alias("there"), beyond("q", "p", "zero_b", "zero_a").alias("back"))
    bits = 31
    high, low = (lambda v: F.sum(F.shiftright(v, bits))), (lambda v: F.sum(F.col(v).bitwiseAND((1 << bits) - 1)))
    parts = [f(v).alias(f"{v}_{k}") for v in ("there", "back") for k, f in (("high", high), ("low", low))]
    sums = met.groupBy(*pair).agg(F.count(F.lit(1)).alias("m"), *parts)

    def whole(v: str, zero_p: str, zero_q: str) -> Column:
        total = F.col(f"{v}_high").cast("decimal(20,0)") * F.lit(1 << bits).cast("decimal(10,0)") + F.col(f"{v}_low")
        none = _gap(F.col(zero_p), F.col(zero_q)).cast("decimal(20,0)") * F.col("m").cast("decimal(17,0)")
        return (total + none).cast("decimal(38,0)").alias("value")

    there = F.struct("source", "item", whole("there", "zero_a", "zero_b"))
    back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), whole("back", "zero_b", "zero_a"))
    return sums.select("lang", F.inline(F.array(there, back)))


def _pairs(used: DataFrame, kept: DataFrame, stats: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language; see the head of the module."""
    zero = _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))
    side = stats.select("lang", "source", "total", "terms", zero.alias("zero"))
    a = side.select("lang", "source", F.col("total").alias("total_a"), "terms", F.col("zero").alias("zero_a"))
    b = side.select("lang", F.col("source").alias("item"), F.col("total").alias("total_b"), F.col("zero").alias("zero_b"))
    sides = a.join(b, "lang").where("source <> item")  # the pairs that are returned

    none = _gap(F.col("zero_a"), F.col("zero_b"))
    p, q = _share(F.col("n_a"), F.col("total_a"), F.col("terms")), _share(F.col("n_b"), F.col("total_b"), F.col("terms"))
    only_a, only_b = _gap(p, F.col("zero_b")), _gap(F.col("zero_a"), q)

    def added(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
        part = rows.join(sides, keys).select("lang", "source", "item", (value.cast("decimal(20,0)") * F.col("m").cast("decimal(18,0)")).alias("value"))
        return part.groupBy("lang", "source", "item").agg(F.sum("value").cast("decimal(38,0)").alias("value"))

    counts = materialize(used.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")), "histogram")
    of_a = added(counts.withColumnRenamed("n", "n_a"), ["lang", "source"], only_a - none)
    of_b = added(counts.select("lang", F.col("source").alias("item"), F.col("n").alias("n_b"), "m"), ["lang", "item"], only_b - none)
    of_both = _common(kept, stats.select("lang", "source", "total", "terms", zero.alias("zero")))
    of_all = sides.select("lang", "source", "item", (none.cast("decimal(20,0)") * F.col("terms").cast("decimal(18,0)")).cast("decimal(38,0)").alias("value"))
    parts = of_all.unionByName(of_a).unionByName(of_b).unionByName(of_both)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
