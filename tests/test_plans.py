"""Dataset builders and suites on small literal inputs."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.models import grid
from panelspark.models.spec import ModelSpec
from panelspark.models.tables import coef_table, with_header
from panelspark.operators.panel import Panel, chain_index, panel_features
from panelspark.plans import cross_section, ingest, panels, suites
from panelspark.sources.readers import read_wide_csv, read_years
from panelspark.sources.writers import ModelStore, export_table


def test_epidemic_rates_match_years_by_country(spark):
    def report(order, pop, a, b):
        rows = [(0, None, 9.0, 9.0), (3, None, *pop), (4, 20, *a), (5, 380, *b), (6, 400, 1.0, 1.0), (300, 20, 7.0, 7.0)]
        return spark.createDataFrame(rows, "row_id int, code int, x double, y double").select("row_id", "code", *order)

    out = ingest.epidemic_rates(
        {2000: report(["x", "y"], (10.0, 20.0), (1.0, 2.0), (1.0, 2.0)), 2010: report(["y", "x"], (30.0, 20.0), (2.0, 4.0), (0.0, 0.0))},
        ["x", "y"],
        3,
        218,
    )
    got = {r["country"]: r for r in out.collect()}
    assert got["x"]["pop_thousands"] == 20.0 and got["x"]["infection_deaths"] == pytest.approx(4.0 / 20.0)
    assert got["y"]["infection_deaths"] == pytest.approx(8.0 / 20.0)


def test_weekly_mortality_filters_and_national_columns(spark):
    d = date(2020, 4, 4)
    rows = [
        (d, "Ohio", 10.0, 2.0, ingest.PREDICTED, ingest.ALL_CAUSES, None),
        (d, "Iowa", 0.0, 1.0, ingest.PREDICTED, ingest.ALL_CAUSES, None),
        (d, "Utah", 5.0, 1.0, ingest.PREDICTED, ingest.ALL_CAUSES, ingest.SUPPRESSED_COUNTS),
        (d, "Ohio", 99.0, 1.0, "Unweighted", ingest.ALL_CAUSES, None),
        (d, "United States", 100.0, 20.0, ingest.PREDICTED, ingest.ALL_CAUSES, None),
    ]
    raw = spark.createDataFrame(
        rows, "`Week Ending Date` date, State string, `Observed Number` double, Excess double, Type string, Outcome string, Suppress string"
    )
    out = {r["state"]: r for r in ingest.weekly_mortality(raw).collect()}
    assert set(out) == {"Ohio", "Iowa", "United States"}
    assert out["Iowa"]["COVID_mortality_frac"] is None and out["Iowa"]["US_COVID_mortality"] == 20.0


def test_wide_mobility_codes(spark):
    wide = spark.createDataFrame([(date(2020, 3, 1), 1.0, 2.0, None)], "_c0 date, ` AK` double, NA double, ZZ double")
    out = {r["state"]: r["v"] for r in ingest.wide_mobility(wide, "v").collect()}
    assert out == {"Alaska": 1.0, "National": 2.0, "ZZ": None}


def test_text_cleaning(spark):
    swine = spark.createDataFrame([("Ohio", "1,234[12]", "5[131]"), ("Iowa", "(7)", None)], "State string, Cases string, Deaths string")
    out = {r["State"]: (r["Swineflu_Cases"], r["Swineflu_Deaths"]) for r in ingest.swine_flu(swine).collect()}
    assert out == {"Ohio": (1234, 5131), "Iowa": (7, None)}
    flu = spark.createDataFrame(
        [("Ohio", "2018/01", "12"), ("Ohio", "2018/02", "Suppressed"), ("Iowa", "2018/01", "Suppressed")],
        "State string, `Month Code` string, Deaths string",
    )
    assert {tuple(r) for r in ingest.influenza_deaths(flu).collect()} == {("Ohio", 2018, 12.0), ("Iowa", 2018, 0.0)}
    gdp = spark.createDataFrame([("Côte", "1.5"), (None, "..")], "`Country Name` string, `2018` string")
    assert [tuple(r) for r in ingest.gdp_per_capita(gdp, "2018").collect()] == [("Côte", 1.5), (None, None)]


def test_policy_panel_never_adopter_and_tie(spark):
    rows = [("Ohio", "StayAtHome", 1, date(2020, 1, 24)), ("Ohio", "StayAtHome", 1, date(2020, 1, 24)), ("Ohio", "EmergDec", 0, date(2020, 1, 23)),
            ("Iowa", "StayAtHome", 1, None)]
    policy = spark.createDataFrame(rows, "StateName string, StatePolicy string, Mandate int, DateEnacted date")
    out = panels.policy_panel(policy)
    assert out.count() == 2 * 92
    assert out.agg(F.sum("StayAtHome")).first()[0] == 90 and out.agg(F.sum("EmergDec")).first()[0] == 0


def test_policy_delays(spark):
    policy = spark.createDataFrame(
        [("Ohio", "A", 1, 1, date(2020, 3, 10)), ("Ohio", "A", 1, 1, date(2020, 3, 12)), ("Ohio", "B", 1, 1, date(2020, 3, 20)), ("Ohio", "C", 1, 0, date(2020, 1, 1)),
         ("Iowa", "A", 1, 1, date(2020, 3, 5))],
        "State string, StatePolicy string, Mandate int, StateWide int, DateIssued date",
    )
    marks = spark.createDataFrame([("Ohio", date(2020, 3, 1), date(2020, 3, 5)), ("Iowa", None, None)], "State string, First_Case_Date date, First_Death_Date date")
    out = {r["State"]: r for r in cross_section.policy_delays(policy, marks, ["A", "B", "C"], date(2020, 1, 22), date(2020, 2, 29)).collect()}
    assert out["Ohio"]["ndays_first_case"] == 14.0 and out["Iowa"]["ndays_first_case"] is None
    assert out["Iowa"]["ndays_first_uscase"] == 43.0


def test_chained_index(spark):
    df = spark.createDataFrame([("a", t, g) for t, g in enumerate([0.5, 0.1, -0.2])] + [("b", 0, None), ("b", 1, None), ("b", 2, 0.1)], "e string, t int, g double")
    out = {(r["e"], r["t"]): r["i"] for r in chain_index(df, ["e"], ["t"], {"g": "i"}).collect()}
    assert out[("a", 0)] == 0.0 and out[("a", 2)] == pytest.approx(1.1 * 0.8 - 1)
    assert out[("b", 0)] == 0.0 and out[("b", 1)] is None and out[("b", 2)] is None


def test_features_in_blocks_equal_plain(spark):
    rng = np.random.default_rng(1)
    rows = [(e, t, float(v)) for e in ("a", "b") for t, v in enumerate(rng.normal(size=40)) if rng.random() > 0.3]
    df = spark.createDataFrame(rows, "e string, t int, x double")
    plain = panel_features(Panel(df, "e", "t"), ["x"], 5)
    blocks = panel_features(Panel(df, "e", "t", block=3), ["x"], 5)
    assert sorted(map(str, plain.collect())) == sorted(map(str, blocks.select(plain.columns).collect()))


def test_wide_csv_and_years(spark, tmp_path):
    (tmp_path / "w.csv").write_text("id,1/1/24,1/2/24\na,1,2\n")
    wide = read_wide_csv(spark, str(tmp_path / "w.csv"), {"id": "string"}, "int")
    assert wide.columns == ["id", "1/1/24", "1/2/24"] and wide.first()[2] == 2
    for y in (2010, 2011):
        (tmp_path / f"pop{y}.txt").write_text("s\tp\nx\t" + str(y) + "\n")
    years = read_years(spark, [str(tmp_path / f"pop{y}.txt") for y in (2010, 2011)], "s string, p int", sep="\t")
    assert {(r["p"], r["year"]) for r in years.collect()} == {(2010, 2010), (2011, 2011)}


def simulated_panel(spark, n_states=12, n_days=70):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(n_states):
        for d in range(n_days):
            day = date(2020, 1, 27) + timedelta(days=7 * d)
            v = rng.normal(size=8)
            flags = [int(d > 10 + s + 3 * i) for i in range(7)]
            rows.append((f"s{s:02d}", day, 2020 + d // 52, d % 52 + 1, s + 1, 1000 + 10 * s, float(abs(v[0]) * 50 + 5), float(abs(v[1]) * 90 + 5),
                         float(abs(v[2]) + 0.1), *[float(x + v[2]) for x in v[3:6]], float(abs(v[6])), float(abs(v[7])), *flags))
    cols = ("state string, date date, year int, week int, state_id int, population int, COVID_mortality double, COVID_infections double, avg_precip double, "
            "una_distance double, dl_mobility double, twitter_social_distancing double, una_pct_distance double, una_log_distance double, "
            + ", ".join(f"{p} int" for p in panels.POLICIES))
    return spark.createDataFrame(rows, cols)


def test_weekly_suite_shapes_and_tables(spark):
    features = suites.weekly_features(simulated_panel(spark))
    suite = suites.weekly_suite(features)
    assert [len(p.fits) for p in (suite.first_stage, suite.second_stage, suite.two_lag, suite.attenuation)] == [12, 48, 9, 3]
    tables = suite.tables()
    assert len(tables["second_stage_m3"].columns) == 14
    rows = tables["first_stage"].orderBy("row").collect()
    assert rows[0]["label"] == "d_avg_precip" and rows[-3]["label"] == "N"
    assert 0.0 <= suite.equality.p_value <= 1.0
    # A grid member equals the model fitted alone.
    one = grid.run_grid(features, [suite.second_stage.fits[14].spec]).fits[0]
    assert one.beta == pytest.approx(suite.second_stage.fits[14].beta, rel=1e-6, nan_ok=True)
    assert one.se == pytest.approx(suite.second_stage.fits[14].se, rel=1e-6, nan_ok=True)


def test_store_and_export(spark, tmp_path):
    panel = simulated_panel(spark, 6, 20)
    g = grid.run_grid(panel, [ModelSpec("a", "dl_mobility", ["avg_precip"]), ModelSpec("b", "una_distance", ["avg_precip"])])
    store = ModelStore(spark, str(tmp_path / "store"))
    store.save("s", g.fits)
    store.save("s", g.fits)
    store.append("more", g.fits)
    store.append("more", g.fits[:1])
    assert [r["model_id"] for r in store.models("more").orderBy("position").collect()] == ["a", "b", "a"]
    assert store.models("more", 3).count() == 1 and store.coefficients("more").count() == 6
    assert store.coefficients("s").count() == 4 and store.models("s", 2).first()["model_id"] == "b"
    table = coef_table(g.coefficients, g.models, ["avg_precip", "_cons"], ["a", "b"])
    export_table(table, str(tmp_path / "t"), order=["row"])
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert len(lines) == 7 and all(x.endswith("\\\\") for x in lines)
    export_table(with_header(table, {"first": ["b"], "second": ["a"]}), str(tmp_path / "h"), order=["row"])
    headed = [r["value"] for r in spark.read.text(str(tmp_path / "h")).collect()]
    assert headed[0] == " & first & second \\\\" and headed[1] == " & (1) & (2) \\\\" and len(headed) == 9
    est = g["a"].coef("avg_precip")
    assert f"{abs(est):,.3f}" in lines[0]


def test_lag_selection_finds_the_lag(spark):
    panel = simulated_panel(spark, 10, 40).withColumnRenamed("week", "w")
    panel = panel.withColumn("week", F.col("w"))
    panel = panel_features(Panel(panel, "state", "date"), ["dl_mobility", "avg_precip"], 3)
    panel = panel.withColumn("y", 3 * F.col("d_avg_precip_m2") + 0.01 * F.col("COVID_mortality"))
    cv, path = suites.lag_selection(panel, "d_dl_mobility", "d_avg_precip", ["EmergDec", "StayAtHome"], "y", excluded=())
    assert int(np.argmax(np.abs(cv.beta_1se))) == 1 and path.beta.shape == (100, 4)


def test_headers_are_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,1/1/20,1/2/20\nx,1,2\n")
    (tmp_path / "b.csv").write_text("1/2/20,id,1/3/20\n5,y,6\n")
    (tmp_path / "y2001.csv").write_text("k,v\nx,1\n")
    (tmp_path / "y2002.csv").write_text("v,k\n2,x\n")
    wide = read_wide_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], {"id": "string"}, "int")
    got = {r["id"]: (r["1/1/20"], r["1/2/20"], r["1/3/20"]) for r in wide.collect()}
    assert got == {"x": (1, 2, None), "y": (None, 5, 6)}
    with pytest.raises(ValueError):
        read_wide_csv(spark, str(tmp_path / "a.csv"), {"other": "string"}, "int")
    with pytest.raises(Exception, match="header|Header|conform"):
        read_years(spark, [str(tmp_path / "y2001.csv"), str(tmp_path / "y2002.csv")], "k string, v int").collect()
