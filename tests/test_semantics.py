"""Missing-value, date and join rules, one literal case each."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalars as S
from panelspark.operators import aggregates as A
from panelspark.operators import clean, joins
from panelspark.operators.panel import Panel, changes, dense_ids, fill_forward, lag_by, zscore, zscore_by, zscore_panel


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v)
    return df.select(expr.alias("r")).first()["r"]


def test_division_by_zero_is_missing(spark):
    assert one(spark, S.safe_div("a", "b"), a=F.lit(1.0), b=F.lit(0.0)) is None


def test_log_of_nonpositive_is_missing(spark):
    rows = spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "x double").select(S.safe_ln("x").alias("r")).collect()
    assert [r["r"] for r in rows] == [None, None, 0.0]


def test_sums_and_means_of_missing_groups(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None)], "g string, x double")
    got = {
        r["g"]: r
        for r in df.groupBy("g")
        .agg(S.sum_zero("x").alias("z"), S.sum_strict("x").alias("s"), F.avg("x").alias("m"), S.mean_strict("x").alias("ms"))
        .collect()
    }
    assert (got["a"]["z"], got["a"]["s"], got["a"]["m"]) == (0.0, None, None)
    assert (got["b"]["z"], got["b"]["s"], got["b"]["m"], got["b"]["ms"]) == (1.0, None, 1.0, None)


@pytest.mark.parametrize(
    "day,week",
    [("2020-01-01", 1), ("2020-01-07", 1), ("2020-01-08", 2), ("2020-12-30", 52), ("2020-12-31", 52), ("2021-12-31", 52)],
)
def test_week_counts_from_january_first(spark, day, week):
    assert one(spark, S.week52("d"), d=F.lit(day).cast("date")) == week


def test_missing_sorts_last_and_blocks_follow_it(spark):
    df = spark.createDataFrame([("a", None, 3.0), ("a", 1, 1.0), ("a", 2, 2.0)], "e string, t int, x double")
    for block in (None, 1):
        out = {r["t"]: r["x_m1"] for r in lag_by(Panel(df, "e", "t", block), ["x"], [1]).collect()}
        assert out == {1: None, 2: 1.0, None: 2.0}


def test_missing_keys_match_and_left_wins(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 9, 10), ("b", 8, 20)], "k string, v int, w int")
    out = {(r["k"], r["v"], r["w"], r["m"]) for r in joins.merge(left, right, ["k"], keep="all", indicator="m").collect()}
    assert out == {(None, 1, 10, 3), ("a", 2, None, 1), ("b", None, 20, 2)}


@pytest.mark.parametrize("keep", ["all", "matched", "left"])
def test_repeated_key_fails(spark, keep):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "k string, w int")
    with pytest.raises(Exception, match="not unique"):
        joins.merge(left, twice, ["k"], card="m:1", keep=keep).collect()
    with pytest.raises(Exception, match="not unique"):
        joins.merge(twice, left, ["k"], card="1:1", keep=keep).collect()


def test_many_to_one_full_keeps_unmatched_right_rows(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([("a", 5), ("z", 6)], "k string, w int")
    out = {tuple(r) for r in joins.merge(left, right, ["k"], card="m:1", keep="all", indicator="m").collect()}
    assert out == {("a", 1, 5, 3), ("a", 2, 5, 3), ("z", None, 6, 2)}


def test_fill_forward_cascades(spark):
    df = spark.createDataFrame([("a", t, x) for t, x in enumerate([None, 1.0, None, None, 2.0, None])], "e string, t int, x double")
    for block in (None, 2):
        out = fill_forward(Panel(df, "e", "t", block), ["x"]).orderBy("t").collect()
        assert [r["x"] for r in out] == [None, 1.0, 1.0, 1.0, 2.0, 2.0]


def test_change_across_entities_uses_the_row_above(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 4.0)], "e string, t int, x double")
    own = {(r["e"], r["t"]): r["p"] for r in changes(Panel(df, "e", "t"), {"x": ("p", "l")}).collect()}
    across = {(r["e"], r["t"]): r["p"] for r in changes(Panel(df, "e", "t"), {"x": ("p", "l")}, True).collect()}
    assert own == {("a", 1): None, ("a", 2): 1.0, ("b", 1): None}
    assert across == {("a", 1): None, ("a", 2): 1.0, ("b", 1): 1.0}


def test_sd_of_one_row_or_constant_gives_no_zscore(spark):
    df = spark.createDataFrame([("one", 1.0), ("flat", 2.0), ("flat", 2.0), ("ok", 1.0), ("ok", 3.0)], "e string, x double")
    out = zscore_by(df, ["e"], {"x": "z"}).collect()
    assert {r["e"] for r in out if r["z"] is None} == {"one", "flat"}
    assert sorted(round(r["z"], 6) for r in out if r["e"] == "ok") == [-0.707107, 0.707107]


def test_strict_zscore_is_poisoned_by_a_missing_value(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert all(r["z"] is None for r in zscore(df, {"x": "z"}, strict=True).collect())
    assert sum(r["z"] is not None for r in zscore(df, {"x": "z"}).collect()) == 2


def test_two_digit_years_and_bad_dates(spark):
    assert one(spark, S.parse_mdy2("d"), d=F.lit("1/7/20")) == date(2020, 1, 7)
    assert one(spark, S.parse_mdy2("d"), d=F.lit("n/a")) is None
    assert one(spark, S.month_start("d"), d=F.lit("202002")) == date(2020, 2, 1)
    assert one(spark, S.month_start("d", "yyyy/MM"), d=F.lit("2020/11")) == date(2020, 11, 1)


def test_citation_marks(spark):
    assert one(spark, S.count_from_text("d"), d=F.lit("1,234[12]")) == 1234
    assert one(spark, S.strip_citations("d"), d=F.lit("5[131]")) == "5[131]"
    assert one(spark, S.strip_citations("d"), d=F.lit("5[130][1]")) == "5"


def test_lists_and_missing_values(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r["k"] for r in clean.keep_in(df, "k", ["a"], or_null=True).collect()] == ["a", None]
    assert [r["k"] for r in clean.keep_not_in(df, "k", ["a"]).collect()] == ["b", None]


def test_recode_inline_and_joined_agree(spark):
    df = spark.createDataFrame([(" x",), ("y",), (None,)], "k string")
    big = {f"old{i}": f"new{i}" for i in range(150)} | {"x": "X"}
    small = clean.recode(df, "k", {"x": "X"}, trim=True).collect()
    assert {r["k"] for r in small} == {"X", "y", None}
    assert {r["k"] for r in clean.recode(df, "k", big, trim=True).collect()} == {"X", "y", None}


def test_one_row_per_key_puts_missing_last(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 4, 3)], "k string, o int, v int")
    assert A.one_row_per_key(df, ["k"], ["o"]).first()["v"] == 3


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"n{i:04d}",) for i in range(500)] * 2 + [(None,)], "k string").repartition(7)
    assert {tuple(r) for r in dense_ids(df, "k", "id").collect()} == {(f"n{i:04d}", i + 1) for i in range(500)}


def test_recode_table_must_be_unique(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    once = spark.createDataFrame([("a", "A"), (None, "n")], "old string, new string")
    assert {r["k"] for r in clean.recode(df, "k", once).collect()} == {"A", "b"}
    with pytest.raises(Exception, match="not unique"):
        clean.recode(df, "k", once.union(once)).collect()


def test_blocks_follow_composite_and_timestamp_keys(spark):
    rows = [(e, y, d, float(y * 400 + d)) for e in "ab" for y in (2019, 2020) for d in (*range(1, 5), *range(362, 366))]
    df = spark.createDataFrame(rows, "e string, y int, d int, v double").selectExpr("*", "timestamp_seconds(CAST(y AS BIGINT) * 31622400 + d * 86400) AS ts")
    for time in (("y", "d"), ("ts",)):
        plain = lag_by(Panel(df, "e", time), ["v"], [1, 2])
        for block in (3, 5):
            assert sorted(map(tuple, lag_by(Panel(df, "e", time, block=block), ["v"], [1, 2]).collect())) == sorted(map(tuple, plain.collect()))
        holes = df.withColumn("v", F.when(F.col("d") % 3 == 0, F.col("v")))
        want = fill_forward(Panel(holes, "e", time), ["v"]).collect()
        assert sorted(map(str, fill_forward(Panel(holes, "e", time, block=3), ["v"]).collect())) == sorted(map(str, want))


def test_panel_uniqueness_check(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 2, 4.0)], "e string, t int, v double")
    assert lag_by(Panel(df.limit(2), "e", "t").unique(), ["v"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        lag_by(Panel(df, "e", "t").unique(), ["v"]).collect()


def test_interval_maxima(spark):
    rows = [("a", date(2020, 1, d), float(v)) for d, v in ((1, 0), (2, 1), (5, 7), (9, 50))]
    rows += [("b", date(2020, 1, 3), 9.0), ("never", date(2020, 1, 1), 0.0)]
    df = spark.createDataFrame(rows, "e string, d date, x double")
    own = dict(joins.max_after_first(df, "e", "d", "x", 3, "m").collect())
    assert own == {"a": 7.0, "b": 9.0, "never": 0.0}
    national = dict(joins.max_after_first(df, "e", "d", "x", 3, "m", national=True).collect())
    assert national == {"a": 9.0, "b": 9.0, "never": 0.0}


def test_natural_joins_match_missing_keys(spark):
    a = spark.createDataFrame([(1, "x", 10), (None, "x", 20), (None, None, 30), (4, "z", 40)], "k int, s string, a int")
    b = spark.createDataFrame([(1, "x", 1), (None, "x", 2), (None, None, 3), (5, None, 5)], "k int, s string, b int")
    inner = {tuple(r) for r in joins.natural_join(a, b).select("k", "s", "a", "b").collect()}
    assert inner == {(1, "x", 10, 1), (None, "x", 20, 2), (None, None, 30, 3)}
    full = {tuple(r) for r in joins.natural_join(a, b, "full_outer").select("k", "s", "a", "b").collect()}
    assert full == inner | {(4, "z", 40, None), (5, None, None, 5)}
    assert {tuple(r) for r in joins.natural_join(a, b, "left_anti").collect()} == {(4, "z", 40)}
    c = spark.createDataFrame([(1, "x", 7), (None, None, 9)], "k int, s string, c int")
    assert {tuple(r) for r in joins.join_all([a, b, c]).select("k", "a", "b", "c").collect()} == {(1, 10, 1, 7), (None, 30, 3, 9)}
    assert joins.join_all([a, c], ["k", "s"]).count() == 2
    with pytest.raises(ValueError):
        joins.join_all([a, b.withColumnRenamed("b", "a")], ["k"])


def test_block_in_changes_and_zscores(spark):
    """Long histories in blocks give what whole entities give."""
    rows = [(e, t, float((t * 7 + i * 3) % 11 + 1)) for i, e in enumerate("abc") for t in range(3, 60) if (t + i) % 9]
    df = spark.createDataFrame(rows, "e string, t int, x double").repartition(4)
    cols = {"x": ("pct", "log")}
    whole, cut = Panel(df, "e", "t"), Panel(df, "e", "t", block=10)

    def rounded(out):
        return {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in out.collect()}

    for across in (False, True):
        assert rounded(changes(whole, cols, across)) == rounded(changes(cut, cols, across))
    ordered = sorted(rows)
    want = {(e, t): round(x / ordered[i - 1][2] - 1, 9) if i else None for i, (e, t, x) in enumerate(ordered)}
    assert {(r["e"], r["t"]): None if r["pct"] is None else round(r["pct"], 9) for r in changes(cut, cols, True).collect()} == want
    assert rounded(zscore_panel(whole, {"x": "z"}).select("e", "t", "z")) == rounded(zscore_panel(cut, {"x": "z"}).select("e", "t", "z"))
