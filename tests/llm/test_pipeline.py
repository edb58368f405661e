"""The pipeline against its stages' plain effects, and the registry."""

import random

import corpus_pipeline
import __spark_entry__ as entry
from panelspark.llm.queries import QUERIES, SQL


def _words(rng, n, pool=4000):
    return " ".join(f"w{rng.randint(0, pool)}x" for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    item = _words(rng, 30)
    shared = _words(rng, 60)
    docs = {i: _words(rng, rng.randint(30, 400)) for i in range(300)}
    for i in range(0, 100):
        docs[i] += " you idiot and moron"
    near = docs[150].split()
    near[3] = "changed"
    docs |= {400: docs[150], 401: " ".join(near), 402: "an own beginning " + _words(rng, 80) + "\n" + shared, 403: shared + "\n" + _words(rng, 90)}
    docs |= {404: _words(rng, 40) + " " + item + " " + _words(rng, 40), 405: "", 406: None}
    rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 100)) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.dtypes == frame.dtypes
        frame = after
        seen[name] = {r["doc_id"]: r.asDict() for r in after.collect()}
    clean = set(docs) - set(range(100))
    assert set(seen["toxicity"]) == clean
    # 405 and 406 have the same (empty) words
    assert set(seen["near_duplicates"]) == clean - {400, 401, 406}
    lines = seen["repeated_lines"]
    assert set(lines) == set(seen["near_duplicates"])
    assert shared in lines[402]["text"] and shared not in lines[403]["text"] and lines[403]["n_chars"] == len(lines[403]["text"])
    assert all(lines[i]["text"] == docs[i] for i in lines if i != 403)
    assert set(seen["decontamination"]) == set(lines) - {404}
    assert set(seen["packing"]) == set(seen["decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frame.count()


def test_edges(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text, and no row at all go through every stage."""
    rng = random.Random(5)
    long = "\n".join(_words(rng, 30) for _ in range(20_000))
    rows = [(None, _words(rng, 50)), (None, None), (1, ""), (2, long), (3, _words(rng, 40)), (3, _words(rng, 40)), (4, " \n\t ")]
    rows += [(5, _words(rng, 60))] * 3
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, root int"
    full = [(i, t, None, "s", None, None, 1) for i, t in rows]
    for name, given in (("full", full), ("none", [])):
        place = f"{tmp_path}/{name}"
        spark.createDataFrame(given, schema).repartition(3).write.parquet(f"{place}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (5, 0, None)] if given else [], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "")] if given else [], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
        packed = corpus_pipeline.run(spark, place).collect()
        if not given:
            assert packed == []
            continue
        # one blank text, one of the repeated rows, every other text
        assert sorted((r["doc_id"] or 0, r["piece"]) for r in packed if r["doc_id"] != 2) == [(0, 0), (1, 0), (3, 0), (3, 0), (5, 0)]
        assert [r["piece"] for r in sorted(packed, key=lambda r: r["piece"]) if r["doc_id"] == 2] == list(range(sum(r["doc_id"] == 2 for r in packed)))
        assert sum(r["doc_id"] == 2 for r in packed) > 500


def test_registry():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(SQL) <= set(entry.oracle_sql())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
