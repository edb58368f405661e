"""Rows that the suites' queries return beside the coefficients."""

from querybook import load_all

SF = "/root/testdata/sf0.001"
QUERIES = load_all()


def test_first_stage_f_list(spark):
    got = QUERIES["L19_first_stage_f_list"].run(spark, SF).collect()
    measures = ("d_dl_mobility", "d_una_distance", "d_twitter_sd")
    assert {r["model_id"] for r in got} == {f"{k}_{m}" for k in "abcd" for m in measures} and len(got) == 12
    known = {r["model_id"]: tuple(r) for r in QUERIES["L19_first_stage_f"].run(spark, SF).collect()}
    assert known == {r["model_id"]: tuple(r) for r in got if r["model_id"] in known}


def test_country_suite_has_estimates(spark):
    rows = QUERIES["L22_country_iv_suite"].run(spark, SF).collect()
    assert any(r["estimate"] is not None and r["std_error"] is not None for r in rows)
    assert any(r["estimate"] is None and r["statistic"] is not None for r in rows)
