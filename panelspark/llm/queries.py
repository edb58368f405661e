"""One registered query per operator, with production parameters over the whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import scratch_path

from . import langid, quality, toxicity
from .collocations import collocations
from .common import held_out, table, tokenizer_path
from .maxscore import top_k
from .packing import pack_documents
from .simhash import simhash_classes
from .source_divergence import divergence
from .substring_dedup import dedup_units
from .token_counts import count_tokens
from .token_file import read_tokens, write_tokens
from .url_reputation import Rule, judge_urls
from .winnowing import contamination

# Fixed rules of the URL query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
BPE = "byte_bpe_50k.json"
PIECES = "byte_bpe_50k.tiktoken"


def _cut_lines(spark: SparkSession, sf_dir: str, min_words: int, window: int | None = None) -> DataFrame:
    cut = dedup_units(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=min_words, window=window)
    kept, gone = (F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c) for c in ("kept_spans", "removed_spans"))
    removed = F.size("removed_spans").alias("n_removed")
    return cut.select("doc_id", F.col("clean_text").alias("text"), "n_units", removed, "passage_words", gone, kept)


def op1_substring_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of any length that came earlier are cut from every document."""
    return _cut_lines(spark, sf_dir, 1)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of four words or more that came earlier are cut from every document."""
    return _cut_lines(spark, sf_dir, 4)


def op1_substring_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of any length that came earlier, and passages of 51 words or more that an earlier document has, are cut from every document; ``passage_words``
    are the words of such passages, first copies included."""
    return _cut_lines(spark, sf_dir, 1, 51)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word fingerprints differ in two bits at most."""
    return simhash_classes(table(spark, sf_dir, "documents"), shingle=3, radius=2, words=1)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 2,048 tokens at most, in 16 optimal length buckets and batches of 65,536 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(BPE))


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = scratch_path(spark, "token-file")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(BPE), end_id=2)
    return read_tokens(spark, path, with_ids=False)


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of highest inner product for every row whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~out), tokenizer_path(PIECES))
    return langid.predict(docs, model, extra=out)


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; a page's outcome is bad if the document that its url numbers is labelled toxic or of low quality."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    number = F.regexp_extract(F.coalesce("url", F.lit("")), "://[^/?#]*/[^/?#]*/([0-9]{1,18})", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.when(number != "", number.cast("long")).alias("number"))
    labelled = pages.join(labels, F.col("number") == F.col("doc_id"), "left")
    judged = judge_urls(labelled, RULES, outcome=F.col("bad"))
    return judged.select(
        "page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows that are not held out."""
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull() & ~out)
    return toxicity.predict(docs, model, extra=out)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word windows of benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (x["hi"] - x["lo"]).cast("long"))
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), names.alias("names")).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the rows that are not held out."""
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull() & ~out)
    return quality.predict(docs, model, extra=out)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 1,024 tokens."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(BPE), limit=1024)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of two to four words that every language binds most."""
    return collocations(table(spark, sf_dir, "documents"), least=30, inside=80, top=2000)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and other sources that every source of every language differs from most."""
    return divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup_all, op1_substring_dedup, op1_substring_dedup_passages, op2_simhash, op3_packing, op4_token_file, op5_maxscore, op6_language,
        op7_url_reputation, op8_toxicity, op9_winnowing, op10_quality, op11_token_counts, op12_collocations, op13_source_divergence,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINES_SQL = rf"""
WITH u AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS place
  FROM documents WHERE text IS NOT NULL),
n AS (
  SELECT *, trim(regexp_replace(translate(l, '{_UPPER}', '{_LOWER}'), '[ \t\r\n\x0b\x0c]+', ' ', 'g'), ' ') AS norm,
         sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY place) - length(l) - 1 AS a FROM u),
c AS (
  SELECT *, norm <> '' AND len(string_split(norm, ' ')) >= 4 AS counted,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) > 1 AS later FROM n),
e AS (SELECT *, counted AND count(*) OVER (PARTITION BY norm) > 1 AS again FROM c),
s AS (
  SELECT *, sum(CASE WHEN norm <> '' AND NOT again THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY place) AS run FROM e),
b AS (
  SELECT doc_id, max(words) AS words FROM (
    SELECT doc_id, run, sum(CASE WHEN again THEN len(string_split(norm, ' ')) ELSE 0 END) AS words FROM s GROUP BY doc_id, run) q GROUP BY doc_id),
g AS (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY place) FILTER (NOT (counted AND later)) AS text, count(*) AS n_units,
         string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(l) AS BIGINT), ',' ORDER BY place) FILTER (NOT (counted AND later)) AS kept_spans,
         count(*) FILTER (counted AND later) AS n_removed,
         string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(l) AS BIGINT), ',' ORDER BY place) FILTER (counted AND later) AS removed_spans
  FROM c GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text, CAST(coalesce(n_units, 0) AS INTEGER) AS n_units,
       CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed, coalesce(removed_spans, '') AS removed_spans,
       coalesce(kept_spans, '') AS kept_spans, CAST(CASE WHEN words > 12 THEN words ELSE 0 END AS INTEGER) AS passage_words
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN b USING (doc_id)"""

_ALL_LINES_SQL = _LINES_SQL.replace("norm <> '' AND len(string_split(norm, ' ')) >= 4 AS counted", "norm <> '' AS counted")

_PASSAGES_SQL = rf"""
WITH u AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS place
  FROM documents WHERE text IS NOT NULL),
n AS (
  SELECT *, trim(regexp_replace(translate(l, '{_UPPER}', '{_LOWER}'), '[ \t\r\n\x0b\x0c]+', ' ', 'g'), ' ') AS norm,
         CAST(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY place) AS BIGINT) - length(l) - 1 AS a FROM u),
c AS (SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) > 1 AS later FROM n),
parts AS (SELECT doc_id, place, a, regexp_extract_all(l, '[^ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]+') AS x FROM c),
t AS (SELECT doc_id, place, a, unnest(x) AS w, unnest(range(len(x))) AS k FROM parts),
e AS (SELECT doc_id, place, w, k, a + CAST(sum(length(w)) OVER (PARTITION BY doc_id, place ORDER BY k) AS BIGINT) AS z FROM t),
w AS (
  SELECT doc_id, place, z - length(w) AS s, z, translate(w, '{_UPPER}', '{_LOWER}') AS w, row_number() OVER (PARTITION BY doc_id ORDER BY place, k) AS i
  FROM e WHERE regexp_matches(w, '[^ \t\r\x0b\x0c]')),
win AS (
  SELECT doc_id, i, md5(string_agg(w, ' ') OVER r) AS passage FROM w
  WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING) QUALIFY count(*) OVER r = 51),
firsts AS (SELECT passage, min(doc_id) AS first FROM win GROUP BY passage HAVING min(doc_id) <> max(doc_id)),
shared AS (SELECT doc_id, i, doc_id > first AS later FROM win JOIN firsts USING (passage)),
marked AS (
  SELECT w.*, coalesce(bool_or(h.later) OVER r, FALSE) AS cut, count(h.later) OVER r > 0 AS common FROM w LEFT JOIN shared h ON w.doc_id = h.doc_id AND w.i = h.i
  WINDOW r AS (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 50 PRECEDING AND CURRENT ROW)),
lines AS (SELECT doc_id, place, bool_or(cut) AS any_cut, bool_and(cut) AS all_cut FROM marked GROUP BY doc_id, place),
j AS (
  SELECT c.doc_id, place, l, a, later OR coalesce(all_cut, FALSE) AS gone, NOT later AND coalesce(any_cut AND NOT all_cut, FALSE) AS broken
  FROM c LEFT JOIN lines USING (doc_id, place)),
turns AS (
  SELECT m.doc_id, m.place, s, z, cut, i - row_number() OVER (PARTITION BY m.doc_id, m.place, cut ORDER BY i) AS run
  FROM marked m JOIN j ON m.doc_id = j.doc_id AND m.place = j.place WHERE broken),
spans AS (
  SELECT doc_id, place, a AS s, a + length(l) AS z, gone FROM j WHERE NOT broken
  UNION ALL SELECT doc_id, place, min(s), max(z), cut FROM turns GROUP BY doc_id, place, cut, run),
kept AS (
  SELECT doc_id, place, string_agg(substr(l, CAST(s - a AS INTEGER) + 1, CAST(z - s AS INTEGER)), ' ' ORDER BY s) AS body
  FROM spans JOIN j USING (doc_id, place) WHERE NOT spans.gone GROUP BY doc_id, place),
texts AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY place) AS text FROM kept GROUP BY doc_id),
g AS (
  SELECT doc_id, string_agg(s || '-' || z, ',' ORDER BY s, z) FILTER (NOT gone) AS kept_spans, count(*) FILTER (gone) AS n_removed,
         string_agg(s || '-' || z, ',' ORDER BY s, z) FILTER (gone) AS removed_spans, count(DISTINCT place) AS n_units
  FROM spans GROUP BY doc_id),
b AS (SELECT doc_id, count(*) FILTER (common) AS words FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(texts.text, '') END AS text, CAST(coalesce(n_units, 0) AS INTEGER) AS n_units,
       CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed, coalesce(removed_spans, '') AS removed_spans,
       coalesce(kept_spans, '') AS kept_spans, CAST(coalesce(words, 0) AS INTEGER) AS passage_words
FROM documents d LEFT JOIN texts USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN b USING (doc_id)"""

_TOP_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5"""

_STRENGTH = """SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN 1.0
    WHEN sum(n * power(bad / n - prior, 2)) <= sum(prior * (1 - prior)) THEN 1000.0
    ELSE least(1000.0, greatest(1.0, (sum(n * prior * (1 - prior)) / sum(n))
      / ((sum(n * power(bad / n - prior, 2)) - sum(prior * (1 - prior))) / sum(n)) - 1)) END AS k FROM {0} WHERE n > 0"""

_RULES_SQL = "CASE " + " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{{i}}}'"
    for i, r in sorted(enumerate(RULES), key=lambda x: -len(x[1].text))
) + " END"

_URL_SQL = rf"""
WITH p0 AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p1 AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM p0),
lab AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END) AS bad
  FROM labels GROUP BY doc_id),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, bad
  FROM p1 LEFT JOIN lab ON TRY_CAST(nullif(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]{{1,18}})', 1), '') AS BIGINT) = doc_id),
c AS (
  SELECT host, regexp_extract(host, '([^.]*[.])?[^.]*$', 0) AS domain, regexp_extract(host, '[^.]*$', 0) AS suffix,
         CAST(count(bad) AS DOUBLE) AS n, coalesce(CAST(sum(bad) AS DOUBLE), 0.0) AS bad FROM p GROUP BY host),
t AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM c) AS prior FROM c GROUP BY suffix),
tk AS ({_STRENGTH.format('t')}),
tm AS (SELECT suffix, (prior * k + bad) / (k + n) AS prior FROM t, tk),
m AS (SELECT domain, c.suffix, sum(n) AS n, sum(bad) AS bad, prior FROM c JOIN tm ON c.suffix = tm.suffix GROUP BY domain, c.suffix, prior),
mk AS ({_STRENGTH.format('m')}),
mm AS (SELECT domain, suffix, (prior * k + bad) / (k + n) AS prior FROM m, mk),
h AS (SELECT c.host, c.n, c.bad, prior FROM c JOIN mm ON c.domain = mm.domain AND c.suffix = mm.suffix),
hk AS ({_STRENGTH.format('h')}),
hm AS (SELECT host, n, bad, (prior * k + bad) / (k + n) AS mean, k FROM h, hk),
hb AS (SELECT *, greatest(0.0, mean - 1.645 * sqrt(mean * (1 - mean) / (k + n + 1))) AS bound FROM hm),
j AS (SELECT page_id, host, path, {_RULES_SQL.format(*(r.verdict + ' ' + r.text for r in RULES))} AS found, n, hb.bad, mean, bound
      FROM p JOIN hb USING (host))
SELECT page_id, host, path, string_split(found, ' ')[2] AS rule,
       coalesce(string_split(found, ' ')[1], CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n AS BIGINT) AS n_labelled, CAST(bad AS BIGINT) AS n_bad, round(mean, 6) AS bad_rate, round(bound, 6) AS bad_bound FROM j"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WINDOWS_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest([array_to_string(w[i:i + 9], ' ') for i in range(1, greatest(len(w) - 8, 2))]) AS g
  FROM b WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, len(w) - m + 2)]) AS g,
         unnest(range(1, len(w) - m + 2)) AS place FROM d, ms WHERE len(w) >= m),
hit AS (SELECT doc_id, item_id, dw.m, place FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + m)) AS x FROM hit) q GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""

_DIVERGENCE_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
         translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
w AS (SELECT lang, source, id, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
own AS (SELECT lang, source, sum(n) AS total, count(*) AS v FROM x GROUP BY lang, source),
lx AS (SELECT lang, term, sum(n) AS n FROM x GROUP BY lang, term),
ln AS (SELECT lang, sum(n) AS total FROM lx GROUP BY lang),
p AS (
  SELECT x.lang, x.source, x.term, x.n, 1 + (CAST(1000000000 AS HUGEINT) * (x.n + 1)) // (own.total + own.v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (lx.n + 1)) // (ln.total + own.v) AS q
  FROM x JOIN own ON own.lang = x.lang AND own.source = x.source JOIN lx ON lx.lang = x.lang AND lx.term = x.term JOIN ln ON ln.lang = x.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200"""

_PHRASES_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, len(w) - m + 2)]) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) v(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
t AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.k, k.a, x.a AS l, y.a AS r, (CAST(2000000 AS HUGEINT) * k.a) // (x.a + y.a) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:k.m], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, unnest([array_to_string(w[j:j + size - 1], ' ') for j in range(1, m - size + 2)]) AS phrase
      FROM c, (VALUES (2), (3)) v(size) WHERE size < m),
o AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY lang, phrase),
z AS (
  SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
  FROM low LEFT JOIN o ON o.lang = low.lang AND o.phrase = low.phrase WHERE o.longer IS NULL OR 100 * o.longer < 80 * low.a)
SELECT z.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z JOIN t ON t.lang = z.lang WHERE rank <= 2000"""

SQL: dict[str, str] = {
    "op1_substring_dedup_all": _ALL_LINES_SQL,
    "op1_substring_dedup": _LINES_SQL,
    "op1_substring_dedup_passages": _PASSAGES_SQL,
    "op5_maxscore": _TOP_SQL,
    "op7_url_reputation": _URL_SQL,
    "op9_winnowing": _WINDOWS_SQL,
    "op12_collocations": _PHRASES_SQL,
    "op13_source_divergence": _DIVERGENCE_SQL,
}
