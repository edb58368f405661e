"""Coefficients by level against dense regressions."""

import numpy as np
import pandas as pd
import pytest

from panelspark.models.factors import fit_levels
from panelspark.models.spec import ModelSpec


def made(levels, rows, seed=3):
    rng = np.random.default_rng(seed)
    n = levels * rows
    f = np.repeat(np.arange(levels), rows)
    c = f * 100 + rng.integers(0, 4, n)
    v = rng.normal(size=n) + 0.1 * f
    x = rng.normal(size=n) * 50 + 1000 + v
    w = rng.normal(size=n)
    y = 0.02 * x - 3 * w + (f % 7) * v + f % 5 + rng.normal(size=n) * (1 + 0.2 * (f % 3))
    return pd.DataFrame(dict(f=f, c=c, v=v, x=x, w=w, y=y))


def dense(d, intercept, vce):
    blocks = []
    for lv in np.unique(d.f):
        on = (d.f.values == lv).astype(float)
        blocks += ([on] if intercept else []) + [on * d.v.values]
    design = np.column_stack([*blocks, d.x.values, d.w.values])
    y = d.y.values
    b, *_ = np.linalg.lstsq(design, y, rcond=None)
    u = y - design @ b
    bread = np.linalg.pinv(design.T @ design)
    n, k = len(y), np.linalg.matrix_rank(design)
    if vce == "classical":
        return b, np.sqrt(np.diag(bread) * (u @ u) / (n - k))
    s = np.array([(design * u[:, None])[d.c.values == g].sum(axis=0) for g in np.unique(d.c)])
    g = len(s)
    return b, np.sqrt(np.diag(bread @ s.T @ s @ bread) * g / (g - 1) * (n - 1) / (n - k))


@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("vce", ["classical", "cluster"])
def test_against_dense(spark, vce, intercept):
    d = made(9, 25)
    spec = ModelSpec("m", "y", ["x", "w"], vce=vce, cluster="c" if vce == "cluster" else None)
    holes = pd.concat([d, d.head(3).assign(x=np.nan)])
    fit = fit_levels(spark.createDataFrame(holes).repartition(4), spec, "f", ["v"], intercept)
    b, se = dense(d, intercept, vce)
    assert fit.common.beta == pytest.approx(b[-2:], rel=1e-7) and fit.common.se == pytest.approx(se[-2:], rel=1e-6)
    got = {(r["f"], r["term"]): r for r in fit.levels.collect()}
    names = (["_cons"] if intercept else []) + ["v"]
    assert len(got) == 9 * len(names)
    for i, (lv, term) in enumerate((lv, t) for lv in range(9) for t in names):
        assert got[lv, term]["estimate"] == pytest.approx(b[i], rel=1e-6) and got[lv, term]["std_error"] == pytest.approx(se[i], rel=1e-6)
        assert got[lv, term]["n"] == 25


def test_two_thousand_levels(spark):
    """Levels come from the data; the residuals are orthogonal to every column of every level."""
    d = made(2000, 8)
    fit = fit_levels(spark.createDataFrame(d), ModelSpec("m", "y", ["x", "w"], vce="cluster", cluster="c"), "f", ["v"])
    got = fit.levels.toPandas().pivot(index="f", columns="term", values="estimate")
    assert len(got) == 2000 and fit.common.k == 4002
    j = d.merge(got.rename(columns={"v": "slope"}), left_on="f", right_index=True)
    u = j.y - j["_cons"] - j.slope * j.v - d[["x", "w"]].values @ fit.common.beta
    for column in (np.ones(len(j)), j.v):  # against the size of the sums' terms
        assert (abs((u * column).groupby(j.f).sum()) <= 1e-7 * abs(u * column).groupby(j.f).sum()).all()
    assert abs((u * j.x).sum()) < 1e-7 * abs(u * j.x).sum() and abs((u * j.w).sum()) < 1e-7 * abs(u * j.w).sum()
    within = lambda s: s - s.groupby(d.f).transform("mean") - (d.v - d.v.groupby(d.f).transform("mean")) * d.f.map(
        d.assign(s=s).groupby("f").apply(lambda g: np.polyfit(g.v, g.s, 1)[0], include_groups=False)
    )
    part = np.c_[within(d.x), within(d.w)]
    assert fit.common.beta == pytest.approx(np.linalg.lstsq(part, within(d.y).values, rcond=None)[0], rel=1e-6)


def test_levels_that_cannot_tell(spark):
    """A level of one row, and one whose column is constant, have an intercept only."""
    d = pd.concat([made(4, 20), pd.DataFrame(dict(f=[50, 60, 60], c=[1, 2, 3], v=[1.0, 2.0, 2.0], x=[3.0, 1.0, 2.0], w=[0.0, 1.0, 3.0], y=[1.0, 2.0, 4.0]))])
    fit = fit_levels(spark.createDataFrame(d), ModelSpec("m", "y", ["x", "w"], vce="classical"), "f", ["v"])
    got = {(r["f"], r["term"]): r["estimate"] for r in fit.levels.collect()}
    assert got[50, "v"] is None and got[60, "v"] is None and got[50, "_cons"] is not None and fit.common.k == 4 * 2 + 2 + 2
    with pytest.raises(ValueError):
        fit_levels(spark.createDataFrame(d), ModelSpec("m", "y", ["x"], vce="hc1"), "f", ["v"])
    with pytest.raises(ValueError):
        fit_levels(spark.createDataFrame(d).limit(0), ModelSpec("m", "y", ["x"], vce="classical"), "f", ["v"])
