"""From raw documents to packed training batches: five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import toxicity
from panelspark.llm.common import fresh, table, tokenizer_path
from panelspark.llm.packing import pack_documents
from panelspark.llm.simhash import drop_near_duplicates
from panelspark.llm.substring_dedup import dedup_units
from panelspark.llm.winnowing import contamination
from panelspark.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity is 0.3 or more; learned from all labels.

    Null and empty texts score as texts without words, so they stay unless the labels' share of toxic ones is 0.3 or more; rows with a null id are scored, but
    nothing is learned from them; repeated rows go or stay together; very long texts are scored whole; without a label or without a row the score
    is the labels' smoothed share."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull())
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that hangs together by three-word fingerprints that differ in two bits at most.

    The smallest id stays, null ids last, then by a hash of the text. Null, empty and blank texts are one group; repeated rows are cut to one; very long
    texts are hashed whole; an empty table stays empty."""
    return drop_near_duplicates(docs, shingle=3, radius=2)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length that came earlier, and passages of 51 words or more that an earlier document has, are cut; n_chars follows the text, and every
    document stays.

    Passages may begin and end inside lines. Earlier is by (id, hash of the text, place), null ids first. A null text stays null, an empty one empty; rows that agree in id and text are cut alike;
    very long texts are cut whole; an empty table stays empty."""
    kept = [F.col("clean_text").alias("text") if c == "text" else F.length("clean_text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return dedup_units(docs, min_words=1, window=51).select(*kept)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that share ten words in a row, or a whole shorter item, with the benchmark.

    Null and empty texts share nothing; rows with a null id are judged like others, repeated rows go or stay together; very long texts are searched whole;
    without a benchmark or without a row all stay."""
    id_ = fresh(docs, "hit_id")
    mark = fresh(docs, "hit_mark")
    marked = docs.withColumn(mark, F.xxhash64(F.col("doc_id"), F.col("text")))
    found = contamination(marked.select(mark, "text"), table(spark, sf_dir, "benchmark"), doc_id=mark)
    hits = found.where(F.size("hits") > 0).select(F.col("doc_id").alias(id_)).distinct()
    return marked.join(hits, F.col(mark) == F.col(id_), "left_anti").drop(mark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training batch.

    Null and empty texts are pieces of the end token alone; rows with null or repeated ids are packed like others, each once; a text of more than 2,048 tokens
    is cut into pieces; an empty table gives no place."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_lines", cut_repeated_lines),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# No SQL can train the classifier or hash shingles; the stages are tested against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
