"""Estimators against dense NumPy, and their algebraic properties."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import stats_dist as D
from panelspark.models import bygroup, engine, grid, lasso, linear, wald
from panelspark.models.spec import ModelSpec
from panelspark.operators.clean import interact, poly

G, T = 14, 12


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    g = np.repeat(np.arange(G), T)
    t = np.tile(np.arange(1, T + 1), G)
    x = rng.normal(size=G * T) + 0.2 * g
    z = rng.normal(size=G * T) + 0.4 * x
    z2 = rng.normal(size=G * T)
    w = rng.normal(size=G * T) * 1e4 + 1e6
    u = rng.normal(size=G * T)
    e = 0.7 * z + 0.4 * z2 + x + u
    e2 = 0.5 * z2 - 0.3 * z + 0.5 * u + rng.normal(size=G * T)
    y = 2 + 0.6 * e - 0.3 * e2 - x + 2e-5 * w + 0.4 * u + rng.normal(size=G * T) * (1 + 0.1 * g) + 0.1 * g * t
    return pd.DataFrame(dict(g=g, t=t, x=x, z=z, z2=z2, w=w, e=e, e2=e2, y=y))


@pytest.fixture(scope="module")
def df(spark, data):
    holes = data.copy()
    holes.loc[[3, 50, 51], "x"] = np.nan
    holes.loc[[7], "y"] = np.nan
    return spark.createDataFrame(holes).repartition(5).cache()


@pytest.fixture(scope="module")
def sample(data):
    return data.drop([3, 50, 51, 7]).reset_index(drop=True)


def dummies(v):
    levels = np.unique(v)
    return (v[:, None] == levels[None, :]).astype(float)


def dense(y, x, z=None, vce="hc1", cluster=None, dof="full"):
    z = x if z is None else z
    s = np.linalg.norm(x, axis=0)
    sz = np.linalg.norm(z, axis=0)
    q, _ = np.linalg.qr(z / sz)
    xh = q @ (q.T @ (x / s))
    b = np.linalg.lstsq(xh, y, rcond=1e-11)[0]
    bread = np.linalg.pinv(xh.T @ xh, rcond=1e-11)
    r = y - (x / s) @ b
    n, k = len(y), np.linalg.matrix_rank(x / s, tol=1e-9)
    if vce == "classical":
        v = bread * (r @ r) / (n - k)
    elif vce == "cluster":
        sums = np.array([(xh * r[:, None])[cluster == c].sum(0) for c in np.unique(cluster)])
        m = len(sums)
        v = bread @ sums.T @ sums @ bread * m / (m - 1)
        if dof == "full":
            v = v * (n - 1) / (n - k)
    else:
        weight = r**2
        if vce == "hc2":
            weight = weight / (1 - np.einsum("ij,jk,ik->i", xh, bread, xh))
        v = bread @ ((xh * weight[:, None]).T @ xh) @ bread
        if vce == "hc1" and dof == "full":
            v = v * n / (n - k)
    return b / s, np.sqrt(np.diag(v)) / s, int(k)


def check(fit, ref, tol=1e-6, count=None):
    m = count or len(fit.terms)
    assert fit.beta[:m] == pytest.approx(ref[0][:m], rel=tol)
    assert fit.se[:m] == pytest.approx(ref[1][:m], rel=tol)
    assert fit.k == ref[2]


def specs_and_refs(s):
    y, one, d = s.y.values, np.ones(len(s)), dummies(s.g.values)
    x = np.c_[s.x, s.w]
    t = s.t.values[:, None].astype(float)
    cl = s.g.values
    full = {"a": np.c_[x, one], "fe": np.c_[x, one, d[:, 1:]]}
    full["t1"] = np.c_[x, one, d[:, 1:], d * t]
    full["t2"] = np.c_[full["t1"], d * t * t]
    c = {"vce": "cluster", "cluster": "g"}
    return [
        (ModelSpec("hc1", "y", ["x", "w"]), dense(y, full["a"])),
        (ModelSpec("hc2", "y", ["x", "w"], vce="hc2"), dense(y, full["a"], vce="hc2")),
        (ModelSpec("classical", "y", ["x", "w"], vce="classical"), dense(y, full["a"], vce="classical")),
        (ModelSpec("cluster", "y", ["x", "w"], **c), dense(y, full["a"], vce="cluster", cluster=cl)),
        (ModelSpec("fe_hc1", "y", ["x", "w"], entity="g"), dense(y, full["fe"])),
        (ModelSpec("fe_classical", "y", ["x", "w"], entity="g", vce="classical"), dense(y, full["fe"], vce="classical")),
        (ModelSpec("fe_cluster", "y", ["x", "w"], entity="g", **c), dense(y, full["fe"], vce="cluster", cluster=cl)),
        (ModelSpec("trend1", "y", ["x", "w"], entity="g", trend=("t", 1), **c), dense(y, full["t1"], vce="cluster", cluster=cl)),
        (ModelSpec("trend2", "y", ["x", "w"], entity="g", trend=("t", 2), **c), dense(y, full["t2"], vce="cluster", cluster=cl)),
        (
            ModelSpec("fe_by_time", "y", ["x", "w"], entity="g", vce="cluster", cluster="t"),
            dense(y, full["fe"], vce="cluster", cluster=s.t.values),
        ),
        (
            ModelSpec("iv", "y", ["x"], ["e"], ["z"]),
            dense(y, np.c_[s.e, s.x, one], np.c_[s.x, one, s.z], dof="none"),
        ),
        (
            ModelSpec("iv_over", "y", ["x"], ["e"], ["z", "z2"], dof="full"),
            dense(y, np.c_[s.e, s.x, one], np.c_[s.x, one, s.z, s.z2]),
        ),
        (
            ModelSpec("iv_two", "y", ["x"], ["e", "e2"], ["z", "z2"], entity="g", **c),
            dense(
                y, np.c_[s.e, s.e2, s.x, one, d[:, 1:]], np.c_[s.x, one, d[:, 1:], s.z, s.z2], vce="cluster", cluster=cl, dof="cluster"
            ),
        ),
        (
            ModelSpec("iv_fe_hc", "y", ["x"], ["e"], ["z"], entity="g"),
            dense(y, np.c_[s.e, s.x, one, d[:, 1:]], np.c_[s.x, one, d[:, 1:], s.z], dof="none"),
        ),
    ]


def test_batch_matches_dense(df, sample):
    pairs = specs_and_refs(sample)
    fits = engine.fit_all(df, [p[0] for p in pairs])
    for fit, (spec, ref) in zip(fits, pairs):
        assert fit.spec.name == spec.name and fit.n == len(sample)
        check(fit, ref)


@pytest.mark.parametrize("degree", [1, 2])
@pytest.mark.parametrize("vce", ["classical", "hc0", "hc1", "cluster"])
def test_constant_under_trends(df, sample, degree, vce):
    """The base entity's intercept at time zero with its error, also where clusters are not the entities; mixed with models of other trends."""
    s = sample.assign(c=sample.t % 5)
    given = df.withColumn("c", F.col("t") % 5)
    d, t, one = dummies(s.g.values), s.t.values[:, None].astype(float), np.ones(len(s))
    effects = np.c_[one, d[:, 1:], d * t] if degree == 1 else np.c_[one, d[:, 1:], d * t, d * t * t]
    x = np.c_[s.x, s.w, effects]
    opt = dict(entity="g", vce=vce, cluster="c" if vce == "cluster" else None)
    ref = dense(s.y.values, x, vce=vce, cluster=s.c.values)
    other = ModelSpec("other", "y", ["x"], trend=("t", 3 - degree), **opt)
    fit = engine.fit_all(given, [ModelSpec("m", "y", ["x", "w"], trend=("t", degree), **opt), other, ModelSpec("fe", "y", ["x"], **opt)])[0]
    assert fit.terms[-1] == "_cons"
    check(fit, ref, tol=1e-5)
    if vce == "classical":
        return
    iv = linear.fit(given, ModelSpec("iv", "y", ["x"], ["e"], ["z", "z2"], trend=("t", degree), dof="none" if vce != "cluster" else "cluster", **opt))
    z, xe = np.c_[s.z, s.z2, s.x, effects], np.c_[s.e, s.x, effects]
    want = dense(s.y.values, xe, z, vce="cluster" if vce == "cluster" else "hc0", cluster=s.c.values, dof="cluster" if vce == "cluster" else "none")
    assert iv.beta == pytest.approx(want[0][:3], rel=1e-5) and iv.se == pytest.approx(want[1][:3], rel=1e-5)


def test_two_way_effects(df, sample):
    s = sample
    x = np.c_[s.x, s.w, np.ones(len(s)), dummies(s.g.values)[:, 1:], dummies(s.t.values)[:, 1:]]
    ref = dense(s.y.values, x, vce="cluster", cluster=s.g.values)
    fit = linear.fit_two_way(df, ModelSpec("tw", "y", ["x", "w"], entity="g", vce="cluster", cluster="g"), "t")
    assert fit.terms == ["x", "w", "_cons"] and fit.k == x.shape[1]
    check(fit, ref, count=3)
    for vce in ("hc1", "classical"):
        check(linear.fit_two_way(df, ModelSpec("tw", "y", ["x", "w"], entity="g", vce=vce), "t"), dense(s.y.values, x, vce=vce), count=3)
    without = linear.fit_two_way(df, ModelSpec("tw", "y", ["x", "w"], entity="g", vce="cluster", cluster="g", constant=False), "t")
    assert without.terms == ["x", "w"] and without.coef("x") == pytest.approx(fit.coef("x")) and without.k == fit.k
    q, _ = np.linalg.qr(x)
    y = s.y.values
    r2 = 1 - np.sum((y - q @ (q.T @ y)) ** 2) / np.sum((y - y.mean()) ** 2)
    assert fit.r2 == pytest.approx(r2, rel=1e-8)
    assert fit.adj_r2 == pytest.approx(1 - (1 - r2) * (len(y) - 1) / (len(y) - ref[2]), rel=1e-8)


def test_two_way_effects_of_many_periods(spark):
    rng = np.random.default_rng(3)
    g, t = np.repeat(np.arange(12), 2500), np.tile(np.arange(2500), 12)
    keep = rng.random(len(g)) < 0.7
    g, t = g[keep], t[keep]
    x = rng.normal(size=len(g)) + 0.1 * g + np.sin(t)
    y = 1.5 * x + g + 3 * np.cos(t) + rng.normal(size=len(g))
    frame = spark.createDataFrame(pd.DataFrame(dict(g=g, t=t, x=x, y=y)))
    fit = linear.fit_two_way(frame, ModelSpec("tw", "y", ["x"], entity="g", vce="classical"), "t")
    a, b = x.copy(), y.copy()
    for v in (a, b):
        for _ in range(200):
            for k in (g, t):
                v -= (np.bincount(k, v) / np.maximum(np.bincount(k), 1))[k]
    assert fit.coef("x") == pytest.approx(a @ b / (a @ a), rel=1e-9)


def test_two_way_effects_of_a_chain(spark):
    """5,000 periods that hang together by entities which live for two of them."""
    rng = np.random.default_rng(4)
    g = np.repeat(np.arange(4999), 4)
    t = g + np.tile([0, 0, 1, 1], 4999)
    x = rng.normal(size=len(g)) + 0.01 * g
    y = 1.5 * x + np.sin(g) + 0.1 * t + rng.normal(size=len(g))
    frame = spark.createDataFrame(pd.DataFrame(dict(g=g, t=t, x=x, y=y)))
    fit = linear.fit_two_way(frame, ModelSpec("tw", "y", ["x"], entity="g", vce="classical"), "t")
    # in a chain the effects of the periods take up each entity's difference between its periods
    pair = lambda v: v.reshape(-1, 2) - v.reshape(-1, 2).mean(axis=1, keepdims=True)
    a, b = pair(x).ravel(), pair(y).ravel()
    beta = a @ b / (a @ a)
    assert fit.coef("x") == pytest.approx(beta, rel=1e-8) and fit.k == 1 + 4999 + 5000 - 1
    assert fit.std_error("x") == pytest.approx(np.sqrt(((b - beta * a) ** 2).sum() / (len(g) - fit.k) / (a @ a)), rel=1e-6)


def test_two_way_effects_in_tables(df, monkeypatch):
    """The solver for more periods than the driver holds gives the same."""
    spec = ModelSpec("tw", "y", ["x"], entity="g", vce="hc1")
    want = linear.fit_two_way(df, spec, "t")
    monkeypatch.setattr(linear, "PERIODS", 3)
    got = linear.fit_two_way(df, spec, "t")
    assert got.beta == pytest.approx(want.beta, rel=1e-8) and got.se == pytest.approx(want.se, rel=1e-8)


def test_entities_far_apart(spark):
    rng = np.random.default_rng(5)
    g = np.repeat(np.arange(8), 40)
    t = np.tile(np.arange(40.0), 8)
    x = rng.normal(size=len(g)) + 1e6 * g
    w = rng.normal(size=len(g)) - 1e6 * g
    y = 1.5 * x - 0.5 * w + rng.normal(size=len(g)) + 1e7 * g
    frame = spark.createDataFrame(pd.DataFrame(dict(g=g, t=t, x=x, w=w, y=y, fixed=1.1 * g)))
    c = {"vce": "cluster", "cluster": "g"}
    fits = engine.fit_all(frame, [ModelSpec("fe", "y", ["x", "w", "fixed"], entity="g", **c), ModelSpec("hc", "y", ["x", "w"], entity="g"), ModelSpec("tr", "y", ["x", "w"], entity="g", trend=("t", 1), **c)])
    within = lambda v: v - (np.bincount(g, v) / 40)[g]
    d = np.c_[within(x), within(w)]
    ref = np.linalg.lstsq(d, within(y), rcond=None)[0]
    for fit in fits[:2]:
        assert [fit.coef("x"), fit.coef("w")] == pytest.approx(ref, rel=1e-6)
    assert math.isnan(fits[0].coef("fixed"))
    u = within(t)
    slopes = lambda v: v - (np.bincount(g, v * u) / np.bincount(g, u * u))[g] * u
    ref = np.linalg.lstsq(np.c_[slopes(d[:, 0]), slopes(d[:, 1])], slopes(within(y)), rcond=None)[0]
    assert [fits[2].coef("x"), fits[2].coef("w")] == pytest.approx(ref, rel=1e-6)


def test_sixty_columns(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 60))
    y = x @ np.linspace(-1, 1, 60) + rng.normal(size=400)
    names = [f"x{i}" for i in range(60)]
    frame = spark.createDataFrame(pd.DataFrame(np.c_[y, x], columns=["y", *names]))
    fit = linear.fit(frame, ModelSpec("wide", "y", names))
    ref = np.linalg.lstsq(np.c_[x, np.ones(400)], y, rcond=None)[0]
    assert fit.beta == pytest.approx(ref, rel=1e-8)


def test_polynomial_and_interactions(df, sample):
    s = sample
    x = s.x.values
    fit = linear.fit(df, ModelSpec("q", "y", poly("x", 4)))
    check(fit, dense(s.y.values, np.c_[x, x**2, x**3, x**4, np.ones(len(s))]), tol=1e-5)
    fit = linear.fit(df, ModelSpec("i", "y", interact("g", [0, 1, 2], "x")))
    cols = np.c_[*[np.where(s.g == g, x, 0.0) for g in (0, 1, 2)], np.ones(len(s))]
    check(fit, dense(s.y.values, cols))


def test_collinear_terms_are_dropped(df, sample):
    fit = linear.fit(df, ModelSpec("m", "y", ["x", ("twice", 2 * F.col("x")), "g"], entity="g", vce="cluster", cluster="g"))
    assert math.isnan(fit.coef("twice")) and math.isnan(fit.coef("g"))
    assert fit.coef("x") == pytest.approx(linear.fit(df, ModelSpec("m", "y", ["x"], entity="g")).coef("x"), rel=1e-9)
    assert fit.coefficient_rows()[1][4] is None


def test_r2_and_adjusted(df, sample):
    s = sample
    x = np.c_[s.x, np.ones(len(s)), dummies(s.g.values)[:, 1:]]
    r = s.y - x @ np.linalg.lstsq(x, s.y, rcond=None)[0]
    tss = ((s.y - s.y.mean()) ** 2).sum()
    fit = linear.fit(df, ModelSpec("m", "y", ["x"], entity="g"))
    assert fit.r2 == pytest.approx(1 - (r @ r) / tss)
    assert fit.adj_r2 == pytest.approx(1 - (r @ r) / (len(s) - x.shape[1]) / (tss / (len(s) - 1)))


def test_residuals_are_orthogonal_and_outside_rows_missing(df, sample):
    spec = ModelSpec("m", "y", ["x", "w"], entity="g", trend=("t", 2))
    out, _ = linear.with_fit(df, spec, "fit", "res")
    got = out.toPandas()
    assert got.res.isna().sum() == 4
    got = got.dropna(subset=["res"])
    assert abs((got.res * got.x).sum()) < 1e-6
    assert abs((got.res * (got.w - 1e6) / 1e4).sum()) < 1e-6
    for power in (0, 1, 2):
        assert (got.res * got.t**power).groupby(got.g).sum().abs().max() < 1e-6
    assert np.allclose(got.fit + got.res, got.y)


def test_partialling_out_identity(df):
    whole = linear.fit(df, ModelSpec("m", "y", ["x", "w"], entity="g"))
    a = linear.residualize(df, ModelSpec("a", "y", ["w"], entity="g"), "ry")
    both = linear.residualize(a.filter("x is not null and not isnan(x) and y is not null and not isnan(y)"), ModelSpec("b", "x", ["w"], entity="g"), "rx")
    part = linear.fit(both, ModelSpec("p", "ry", ["rx"], constant=False))
    clean = df.filter("not isnan(x) and not isnan(y)")
    assert part.coef("rx") == pytest.approx(linear.fit(clean, ModelSpec("m", "y", ["x", "w"], entity="g")).coef("x"), rel=1e-6)
    assert whole.coef("x") == pytest.approx(part.coef("rx"), rel=1e-6)


def test_iv_with_regressor_as_instrument_is_ols(df):
    a = linear.fit(df, ModelSpec("a", "y", ["x", "w"]))
    b = linear.fit(df, ModelSpec("b", "y", ["w"], ["x"], ["x"]))
    assert b.coef("x") == pytest.approx(a.coef("x"), rel=1e-9)


def test_redundant_instrument_changes_nothing(df):
    a = linear.fit(df, ModelSpec("a", "y", ["w"], ["e"], ["z"]))
    b = linear.fit(df, ModelSpec("b", "y", ["w"], ["e"], ["z", ("same", F.col("z") * 3)]))
    assert b.coef("e") == pytest.approx(a.coef("e"), rel=1e-7)


def test_partition_count_and_duplicates(df):
    spec = ModelSpec("m", "y", ["x", "w"], entity="g", vce="cluster", cluster="g")
    a = linear.fit(df, spec)
    b = linear.fit(df.repartition(1), spec)
    c = linear.fit(df.unionByName(df), spec)
    assert b.beta == pytest.approx(a.beta, rel=1e-9) and b.se == pytest.approx(a.se, rel=1e-9)
    assert c.beta == pytest.approx(a.beta, rel=1e-9)


def test_wald_forms(df):
    fit = linear.fit(df, ModelSpec("m", "y", ["x", "w"], vce="cluster", cluster="g"))
    t = wald.test_term(fit, "x")
    assert t.statistic == pytest.approx(fit.statistic("x") ** 2)
    assert (t.df1, t.df2) == (1, G - 1)
    assert t.p_value == pytest.approx(fit.p_value("x"))
    equal = wald.test_equal(fit, "x", "w")
    gap, var = fit.coef("x") - fit.coef("w"), fit.cov[0, 0] + fit.cov[1, 1] - 2 * fit.cov[0, 1]
    assert equal.statistic == pytest.approx(gap**2 / var)
    with pytest.raises(ValueError):
        wald.test_equal(fit, "x", "x")
    joint = wald.test_joint(fit, ["x", "w"])
    v = fit.cov[:2, :2]
    assert joint.statistic == pytest.approx(fit.beta[:2] @ np.linalg.solve(v, fit.beta[:2]) / 2)


def test_equality_of_identical_measures(df):
    same = df.withColumn("e_again", F.col("e"))
    fit, test = grid.equality_test(same, "y", ("e", "e_again"), "z", ["x"], "g")
    assert test.statistic == pytest.approx(0.0, abs=1e-10)
    single = linear.fit(df, ModelSpec("s", "y", ["x"], ["e"], ["z"], entity="g", vce="cluster", cluster="g"))
    assert fit.coef("number=1:both") == pytest.approx(single.coef("e"), rel=1e-8)


def test_iv_diagnostics(df, sample):
    s = sample
    fit = linear.fit(df, ModelSpec("iv", "y", ["x"], ["e"], ["z", "z2"]))
    got = {t.name: t for t in wald.iv_diagnostics(fit)}
    n, one = len(s), np.ones(len(s))

    def rss(y, x):
        r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return r @ r, r

    small, full = np.c_[one, s.x], np.c_[one, s.x, s.z, s.z2]
    (a, _), (b, v) = rss(s.e.values, small), rss(s.e.values, full)
    assert got["weak_instruments:e"].statistic == pytest.approx((a - b) / 2 / (b / (n - 4)))
    (a, _), (b, _) = rss(s.y.values, np.c_[small, s.e]), rss(s.y.values, np.c_[small, s.e, v])
    assert got["wu_hausman"].statistic == pytest.approx((a - b) / (b / (n - 4)), rel=1e-6)
    u = s.y.values - np.c_[s.e, s.x, one] @ fit.beta
    r, _ = rss(u, full)
    assert got["sargan"].statistic == pytest.approx(n * (1 - r / (u @ u)), rel=1e-6)


@pytest.mark.parametrize("vce,entity", [("hc0", None), ("hc1", None), ("cluster", None), ("hc1", "g"), ("cluster", "g")])
def test_robust_iv_diagnostics(df, sample, vce, entity):
    """Two endogenous regressors, three instruments, against dense regressions."""
    s = sample.assign(z3=sample.z * sample.z2)
    s = s.assign(e2=s.e2 + s.z3)
    given = df.withColumn("z3", F.col("z") * F.col("z2")).withColumn("e2", F.col("e2") + F.col("z3"))
    spec = ModelSpec("iv", "y", ["x"], ["e", "e2"], ["z", "z2", "z3"], vce=vce, cluster="g" if vce == "cluster" else None, entity=entity)
    fit, tests = wald.robust_iv_diagnostics(given, spec)
    got = {t.name: t for t in tests}
    n = len(s)
    c = dummies(s.g.values) if entity else np.ones((n, 1))
    exog, endog, instr = np.c_[c, s.x], np.c_[s.e, s.e2], np.c_[s.z, s.z2, s.z3]

    def meat(x, e):
        u = x * e[:, None]
        if vce == "cluster":
            u = np.array([u[s.g.values == g].sum(axis=0) for g in np.unique(s.g)])
        return u.T @ u

    def f(y, x, last):
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        bread = np.linalg.inv(x.T @ x)
        v = bread @ meat(x, y - x @ b) @ bread
        free = n - x.shape[1]
        v *= {"hc0": 1.0, "hc1": n / free, "cluster": G / (G - 1) * (n - 1) / free}[vce]
        return b[-last:] @ np.linalg.solve(v[-last:, -last:], b[-last:]) / last

    z = np.c_[exog, instr]
    hats = z @ np.linalg.lstsq(z, endog, rcond=None)[0]
    for i, name in enumerate(("e", "e2")):
        assert got[f"weak_instruments:{name}"].statistic == pytest.approx(f(endog[:, i], z, 3), rel=1e-6)
    y = s.y.values
    assert got["endogeneity"].statistic == pytest.approx(f(y, np.c_[exog, endog, endog - hats], 2), rel=1e-6)
    xh = np.c_[exog, hats]
    u = y - np.c_[exog, endog] @ np.linalg.lstsq(xh, y, rcond=None)[0]
    r = instr[:, 0] - xh @ np.linalg.lstsq(xh, instr[:, 0], rcond=None)[0]
    over = got["overidentification_score"]
    assert over.statistic == pytest.approx((r @ u) ** 2 / meat(r[:, None], u)[0, 0], rel=1e-5) and over.df1 == 1
    assert got["endogeneity"].df2 == (G - 1 if vce == "cluster" else n - exog.shape[1] - 4)
    assert fit.n == n


def test_robust_diagnostics_need_their_kind(df):
    with pytest.raises(ValueError):
        wald.robust_iv_diagnostics(df, ModelSpec("iv", "y", ["x"], ["e"], ["z"], vce="classical"))
    _, tests = wald.robust_iv_diagnostics(df, ModelSpec("iv", "y", ["x"], ["e"], ["z"]))
    assert [t.name for t in tests] == ["weak_instruments:e", "endogeneity"]


def test_regression_per_group(df, sample):
    out = {r["g"]: r for r in bygroup.ols_by(df.filter("not isnan(x) and not isnan(y)"), "g", "y", "x").collect()}
    for g, part in sample.groupby("g"):
        ref = dense(part.y.values, np.c_[part.x, np.ones(len(part))], vce="hc2")
        assert out[g]["estimate"] == pytest.approx(ref[0][0]) and out[g]["std_error"] == pytest.approx(ref[1][0])


def test_lasso_conditions_and_limits(spark, df):
    x = ["x", "z", "z2", "e"]
    clean = df.filter("not isnan(x) and not isnan(y)")
    data = lasso.standardize(clean.select("g", "t", "y", *x), "y", x).cache()
    path = lasso.lasso_path(data, "y", x)
    p = data.toPandas()
    m, y, n = p[x].values, p.y.values, len(p)
    sd = np.sqrt((m**2).mean(0) - m.mean(0) ** 2)
    for i in (0, 20, 60, 99):
        grad = m.T @ (y - m @ path.beta[i]) / n / sd
        active = path.beta[i] != 0
        assert np.all(np.abs(grad) <= path.lambdas[i] * (1 + 1e-6) + 1e-10)
        assert grad[active] == pytest.approx(np.sign(path.beta[i][active]) * path.lambdas[i], rel=1e-5)
    assert not path.beta[0].any()
    zero = lasso.lasso_path(data, "y", x, lambdas=[0.0])
    assert zero.beta[0] == pytest.approx(np.linalg.lstsq(m, y, rcond=None)[0], rel=1e-6)
    cv = lasso.cv_lasso(data, "y", x, ["g", "t"])
    assert cv.lambda_1se >= cv.lambda_min and len(cv.cvm) == 100
    again = lasso.cv_lasso(data.repartition(3), "y", x, ["g", "t"])
    assert again.lambda_1se == pytest.approx(cv.lambda_1se, rel=1e-9)
    # Held-out errors equal those of an explicit refit.
    folds = data.select("*", lasso.hash_fold(["g", "t"], 10).alias("f")).toPandas()
    i, err = 40, 0.0
    for f in sorted(folds.f.unique()):
        train, test = data.join(spark.createDataFrame(folds[folds.f != f][["g", "t"]]), ["g", "t"]), folds[folds.f == f]
        b = lasso.lasso_path(train, "y", x, lambdas=[cv.path.lambdas[i]]).beta[0]
        err += ((test.y.values - test[x].values @ b) ** 2).sum()
        if f >= 2:
            break
    assert err > 0


def test_tail_probabilities():
    assert D.t_two_sided(2.228138852, 10) == pytest.approx(0.05, rel=1e-7)
    assert D.f_upper(4.102821, 2, 10) == pytest.approx(0.05, rel=1e-5)
    assert D.chi2_upper(3.841458821, 1) == pytest.approx(0.05, rel=1e-7)
    assert D.normal_two_sided(1.959963985) == pytest.approx(0.05, rel=1e-7)


def test_small_entities_under_trends(spark):
    rows = [("a", t, float(t), float(t * t + (t % 3))) for t in range(10)] + [("b", 1, 2.0, 3.0), ("c", 1, 1.0, 1.0), ("c", 2, 5.0, 2.0)]
    d = spark.createDataFrame(rows, "g string, t int, x double, y double").withColumn("x", F.col("x") + (F.col("t") % 4))
    fit = linear.fit(d, ModelSpec("m", "y", ["x"], entity="g", trend=("t", 2), vce="classical"))
    assert fit.k == 1 + 3 + 1 + 2  # one slope; a has three effects, b one, c two
    only = linear.fit(d.filter("g = 'a'"), ModelSpec("m", "y", ["x"], entity="g", trend=("t", 2), vce="classical"))
    assert fit.coef("x") == pytest.approx(only.coef("x"))


def test_unknown_options_fail():
    with pytest.raises(ValueError):
        ModelSpec("m", "y", ["x"], vce="hc9")
    with pytest.raises(ValueError):
        ModelSpec("m", "y", (), ["e"], [])
    with pytest.raises(ValueError):
        replace(ModelSpec("m", "y", ["x"]), vce="cluster")


def test_lasso_moments_far_from_zero(spark):
    """Means a million sds from zero cost the spread no digits, also after a fold is taken out."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 3)) @ np.array([[1, 0.3, 0], [0, 1, 0.2], [0, 0, 1]]) + 1e6
    y = x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=4000)
    d = pd.DataFrame(np.c_[y, x], columns=["y", "a", "b", "c"]).assign(f=np.arange(4000) % 5)
    parts = lasso.moments_by(spark.createDataFrame(d), ["y", "a", "b", "c"], F.col("f").cast("int"))
    total = sum(list(parts.values())[1:], list(parts.values())[0])
    assert total.sd == pytest.approx(x.std(axis=0), rel=1e-9)
    rest = total - parts[2]
    assert rest.n == 3200 and rest.sd == pytest.approx(x[d.f != 2].std(axis=0), rel=1e-8)
    assert rest.c / rest.n == pytest.approx(np.cov(d[d.f != 2][["y", "a", "b", "c"]].values.T, bias=True), rel=1e-7)


def test_lasso_certificate(df):
    data = lasso.standardize(df.select("g", "t", "y", "x", "z", "z2", "e"), "y", ["x", "z", "z2", "e"])
    path = lasso.lasso_path(data.where("not isnan(x) and not isnan(y)"), "y", ["x", "z", "z2", "e"])
    assert path.gap().max() < 1e-6
    path.beta[50] += 0.1
    assert path.gap()[50] > 1e-3


@pytest.mark.parametrize("entity", [None, "g"])
def test_robust_diagnostics_without_a_usable_instrument(spark, entity):
    """Instruments that are zero everywhere leave the endogenous regressor out: no test has a value, and the others' estimates are those of least squares."""
    rows = [(i % 4, float(i % 7) + 0.5 * (i % 3), float(i % 5), float(i * i % 11), 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, y double, x double, e double, z double").withColumn("z2", F.col("z") * F.col("z"))
    fit, tests = wald.robust_iv_diagnostics(df, ModelSpec("iv", "y", ["x"], ["e"], ["z", "z2"], vce="hc1", entity=entity))
    assert [t.name for t in tests] == ["weak_instruments:e", "endogeneity"] and all(np.isnan(t.statistic) for t in tests)
    assert np.isnan(fit.coef("e"))
    ols = linear.fit(df, ModelSpec("ols", "y", ["x"], entity=entity))
    assert fit.coef("x") == pytest.approx(ols.coef("x"))


def test_robust_diagnostics_with_as_many_rows_as_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 1.0, 3.0), (4.0, 5.0, 2.0)], "y double, e double, z double")
    _, tests = wald.robust_iv_diagnostics(df, ModelSpec("iv", "y", [], ["e"], ["z"]))
    assert {t.name: np.isnan(t.statistic) for t in tests} == {"weak_instruments:e": False, "endogeneity": True}
