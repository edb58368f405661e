"""Repeated lines of one to three words."""

import corpus_pipeline
from panelspark.llm.queries import op1_substring_dedup_all

ROWS = [(1, "All rights reserved.\nfirst text of its own\nEnd", 40), (2, "second text of its own\nall  rights RESERVED.\n\nEnd\nEnd", 50)]


def test_short_repeats_are_cut(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: ROWS[0][1], 2: "second text of its own\n"}
    got = {r["doc_id"]: r for r in op1_substring_dedup_all(spark, str(tmp_path)).collect()}
    assert {i: r["text"] for i, r in got.items()} == want and got[2]["n_removed"] == 3
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_lines(spark, docs, str(tmp_path)).collect()} == want
