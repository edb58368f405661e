"""Repeated passages that begin and end inside lines, against a plain version of the rule."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from panelspark.llm import passages
from panelspark.llm.passages import _FACTORS, run_hashes
from panelspark.llm.queries import QUERIES, SQL
from panelspark.llm.substring_dedup import dedup_units
from querybook import check

SCHEMA = "doc_id long, text string"


def plain(rows: set, size: int) -> dict:
    """Text without later lines and without the words of windows that an earlier text has; places go by (id, text's rank among those of the id, word)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    words = {r: list(re.finditer(r"[^ \t\r\n\x0b\x0c]+", r[1])) for r in order}
    seen, lines, cut = {}, set(), {}
    for r in order:
        norm = [m.group().lower() for m in words[r]]
        cut[r] = [False] * len(norm)
        for i in range(len(norm) - size + 1):
            key = tuple(norm[i : i + size])
            if seen.setdefault(key, r) != r:
                cut[r][i : i + size] = [True] * size
    out = {}
    for r in order:
        left, a = [], 0
        for line in r[1].split("\n"):
            here = [(m, c) for m, c in zip(words[r], cut[r]) if a <= m.start() < a + len(line)]
            key, whole = tuple(m.group().lower() for m, _ in here), line
            if here and any(c for _, c in here):
                runs, before = [], True
                for m, c in here:
                    if not c:
                        runs[-1:] = [(runs[-1][0], m.end())] if not before else [*runs[-1:], (m.start(), m.end())]
                    before = c
                whole = " ".join(r[1][x:y] for x, y in runs) if runs else None
            if not (key and key in lines) and whole is not None:
                left.append(whole)
            lines.add(key)
            a += len(line) + 1
        out[r[:2]] = "\n".join(left)
    return out


def passage_rows() -> list:
    rnd = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    shared = [[rnd.choice(vocabulary) for _ in range(rnd.choice((11, 12, 13, 30, 90)))] for _ in range(8)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rnd.randrange(1, 5)):
            words += [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 15))]
            if rnd.random() < 0.6:
                words += [w.upper() if rnd.random() < 0.2 and w.isascii() else w for w in rnd.choice(shared)]
        rows.append((i, "".join(w + rnd.choice((" ", " ", " ", "  ", "\n", "\t", "\n\n")) for w in words)))
    return [*rows, (60, "a " * 100), (61, "x " + "a b " * 40), (62, ""), (63, None), (None, rows[5][1]), (64, rows[6][1]), (64, rows[6][1]), (64, rows[6][1] + " more")]


@pytest.mark.parametrize("size", [12, 25])
def test_passages_against_plain(spark, size):
    rows = passage_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = {(r["doc_id"], r["text"]): r["m"] for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS m").collect()}
    want = plain({(i, t, marks[i, t]) for i, t in rows if t is not None}, size)
    got = dedup_units(docs, min_words=1, window=size).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["clean_text"] == (None if r["text"] is None else want[r["doc_id"], r["text"]])
        for a, b in (r["kept_spans"] or []) + (r["removed_spans"] or []):
            assert 0 <= a <= b <= len(r["text"])
    assert sum(r["clean_text"] != r["text"] for r in got) > 20


def test_hashes_of_runs():
    values = np.random.default_rng(1).integers(0, 1 << 63, 70, np.uint64)
    for size in (1, 2, 16, 36, 51, 70):
        want = [sum(int(v) * pow(_FACTORS[0], size - 1 - j, 1 << 64) for j, v in enumerate(values[i : i + size])) % (1 << 64) for i in range(70 - size + 1)]
        assert run_hashes(values, size, _FACTORS[0]).tolist() == want
    assert len(run_hashes(values, 71, _FACTORS[0])) == 0


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(t or "" for _, t in passage_rows())
    values = passages.word_values(text, passages._Values())
    (at, part, anchors), = passages._blocks(values, 51)
    assert at == 0 and part.tolist() == values.tolist() and len(anchors) == len(values) - 50
    monkeypatch.setattr(passages, "_PART", 100)
    monkeypatch.setattr(passages, "_KNOWN", 10)
    assert passages.word_values(text, passages._Values()).tolist() == values.tolist()
    blocks = list(passages._blocks(values, 51))
    assert len(blocks) > 10 and np.concatenate([a + x for a, _, x in blocks]).tolist() == anchors.tolist()


def test_pipeline_cuts_passages_inside_lines(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(60))
    own = " ".join(f"own{i}" for i in range(60))  # what a document repeats of itself alone stays
    rows = [(1, f"first {passage} one", 0), (2, f"second begins\nhere {passage.replace('word30 ', 'Word30' + chr(10))} and ends", 0), (3, "own text\nof two lines", 0), (4, " ".join(passage.split()[:50]), 0), (5, f"{own} {own}", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.cut_repeated_lines(spark, docs, str(tmp_path)).collect()}
    want = {1: rows[0][1], 2: "second begins\nhere\nand ends", 3: rows[2][1], 4: rows[3][1], 5: rows[4][1]}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def shared_words(rows: set, size: int) -> dict:
    """Words of each text that lie in ``size`` neighbouring words which another text has too."""
    words = {r: re.findall(r"[^ \t\r\n\x0b\x0c]+", r[1].translate(str.maketrans("W", "w"))) for r in rows}
    having = {}
    for r, w in words.items():
        for i in range(len(w) - size + 1):
            having.setdefault(tuple(w[i : i + size]), set()).add(r)
    return {r: len({j for i in range(len(w) - size + 1) if len(having[tuple(w[i : i + size])]) > 1 for j in range(i, i + size)}) for r, w in words.items()}


@pytest.mark.parametrize("size", [12, 25])
def test_passage_words_against_plain(spark, size):
    rows = passage_rows()
    want = shared_words({r for r in rows if r[1] is not None}, size)
    got = dedup_units(spark.createDataFrame(rows, SCHEMA), min_words=1, window=size).collect()
    assert [(r["doc_id"], r["passage_words"]) for r in got] == [(r["doc_id"], want.get((r["doc_id"], r["text"]), 0)) for r in got]
    assert sum(r["passage_words"] > 0 and r["clean_text"] == r["text"] for r in got) > 0  # first copies


def test_passage_twice_in_the_earliest_text(spark):
    """Of two copies in text 1, each amid other words, text 2 has the second one's neighbours too, text 3 neither's."""
    passage, around = (" ".join(f"{x}{i}" for i in range(20)) for x in "pa")
    rows = [(1, f"{' '.join(f'b{i}' for i in range(20))} {passage} x {around} {passage} {around}"), (2, f"y {around} {passage} {around}"), (3, f"z z {passage} u u")]
    got = dedup_units(spark.createDataFrame(rows, SCHEMA), min_words=1, window=12).collect()
    assert {r["doc_id"]: (r["passage_words"], r["clean_text"]) for r in got} == {1: (80, rows[0][1]), 2: (60, "y"), 3: (20, "z z u u")}


def test_common_passage_among_many_others(spark, monkeypatch):
    """One passage in 40 texts, other words around it in each: its outer anchors have a run in every text, and are joined from written tables, so that Spark can split them."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{' '.join(f'a{i}x{j}' for j in range(20))} {passage} {' '.join(f'z{i}x{j}' for j in range(20))}") for i in range(40)]
    plans, write = {}, passages.materialize

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(passages, "materialize", watched)
    got = dedup_units(spark.createDataFrame(rows, SCHEMA), min_words=1, window=25).collect()
    assert [r["clean_text"] for r in got] == [t if i == 0 else t.replace(f" {passage}", "") for i, t in rows]
    assert {r["passage_words"] for r in got} == {40}
    assert "Join" in plans["open-runs"] and "Aggregate" not in plans["open-runs"]


def test_op1_query_cuts_and_tells_passages_inside_lines(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, f"first {passage} one\nAll rights reserved."),
        (2, f"second begins\nhere {passage.replace('word30 ', 'Word30' + chr(10))} and\tends\nall  rights RESERVED."),
        (3, "own text\n\nAll rights reserved."),
        (4, " ".join(passage.split()[:50])),
        (5, None),
        (6, ""),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_substring_dedup_passages"](spark, str(tmp_path))
    cols, found = check._rows(got.columns, [tuple(r) for r in got.collect()])
    by_id = {r[cols.index("doc_id")]: dict(zip(cols, r)) for r in found}
    assert {i: r["text"] for i, r in by_id.items()} == {**dict(rows), 2: "second begins\nhere\nand\tends", 3: "own text\n"}
    assert {i: r["passage_words"] for i, r in by_id.items()} == {1: 60, 2: 60, 3: 0, 4: 0, 5: 0, 6: 0}
    con = check.duck("/nowhere")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(SQL["op1_substring_dedup_passages"])
    assert check._rows([d[0] for d in cur.description], cur.fetchall()) == (cols, found)


def test_no_rows(spark):
    assert dedup_units(spark.createDataFrame([], SCHEMA), window=51).collect() == []
