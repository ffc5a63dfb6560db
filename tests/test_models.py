"""Models against dense textbook solutions and simulated data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import models


def test_anova_unbalanced(spark):
    rng = np.random.default_rng(0)
    rows = [(a, b, float(0.5 * a + 0.3 * b + 0.4 * (a == 1) * (b == 2) + rng.normal())) for a in range(3) for b in range(4) for _ in range(rng.integers(2, 9))]
    df = spark.createDataFrame(rows, "a int, b int, y double")
    a, b, y = (np.array(v) for v in zip(*rows))
    A = np.eye(3)[a]
    B = np.eye(4)[b]
    AB = np.einsum("ni,nj->nij", A, B).reshape(len(y), -1)

    def rss(*blocks):
        x = np.hstack([np.ones((len(y), 1)), *blocks])
        return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())

    got = {r["term"]: r for r in models.two_way_anova(df, "y", "a", "b").collect()}
    assert got["a"]["sumsq"] == pytest.approx(rss() - rss(A))
    assert got["b"]["sumsq"] == pytest.approx(rss(A) - rss(A, B))
    assert got["a:b"]["sumsq"] == pytest.approx(rss(A, B) - rss(AB))
    assert got["Residuals"]["sumsq"] == pytest.approx(rss(AB)) and got["a:b"]["df"] == 6


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(1)
    brain, slc = rng.normal(0, 1.0, 30), rng.normal(0, 0.7, 6)
    rows = []
    for i in range(400):
        g, h, x, r = int(rng.integers(30)), int(rng.integers(6)), float(rng.normal()), int(rng.integers(2))
        rows.append((f"b{g}", f"s{h}", "RSC" if r else "ACC", x, float(2 + 0.8 * r - 0.5 * x + brain[g] + slc[h] + rng.normal(0, 0.6))))
    return rows, spark.createDataFrame(rows, "brain string, slice string, region string, x double, y double")


def dense_reml(rows, theta, use_slice):
    y = np.array([r[4] for r in rows])
    x = np.array([[1, r[2] == "RSC", r[3]] for r in rows], float)
    v = np.eye(len(y))
    for col, t in zip((0, 1) if use_slice else (0,), theta):
        lab = np.array([r[col] for r in rows])
        v += t * t * (lab[:, None] == lab[None, :])
    vi = np.linalg.inv(v)
    xx = x.T @ vi @ x
    beta = np.linalg.solve(xx, x.T @ vi @ y)
    e = y - x @ beta
    dof = len(y) - 3
    s2 = float(e @ vi @ e) / dof
    dev = dof * np.log(2 * np.pi * s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1] + dof
    return dev, beta, s2 * np.linalg.inv(xx), np.sqrt(s2)


@pytest.mark.parametrize("crossed", [None, "slice"])
def test_mixed_model_is_the_dense_reml_optimum(mixed, crossed):
    rows, df = mixed
    fit = models.mixed_model(df, "y", {"region": ["ACC", "RSC"]}, ["x"], "brain", crossed)
    theta = [v / fit.sigma for v in fit.sd_groups.values()]
    dev, beta, cov, sigma = dense_reml(rows, theta, crossed is not None)
    assert fit.reml == pytest.approx(dev, abs=1e-6)
    assert fit.beta == pytest.approx(beta, abs=1e-8) and fit.sigma == pytest.approx(sigma)
    assert np.allclose(fit.cov, cov)
    for i in range(len(theta)):
        for step in (-0.02, 0.02):
            moved = list(theta)
            moved[i] += step
            assert dense_reml(rows, moved, crossed is not None)[0] >= dev - 1e-7
    table = {r["term"]: r for r in fit.anova().collect()}
    assert table["x"]["p"] < 1e-6 and table["region"]["num_df"] == 1
    assert 300 < table["x"]["den_df"] < 400


def test_nested_labels(mixed):
    _, df = mixed
    fit = models.mixed_model(df, "y", {"region": ["ACC", "RSC"]}, ["x"], "brain", "slice", nest=True)
    assert set(fit.sd_groups) == {"brain", "slice"}


def test_gamma_glm_and_diagnostics(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1500):
        r, x = int(rng.integers(2)), float(rng.normal())
        mu = np.exp(0.4 + 0.7 * r - 0.3 * x)
        rows.append((f"k{i}", "RSC" if r else "ACC", x, float(rng.gamma(4.0, mu / 4.0))))
    df = spark.createDataFrame(rows, "key string, region string, x double, y double")
    fit = models.gamma_glm(df, "y", {"region": ["ACC", "RSC"]}, ["x"])
    coef = {r["term"]: r for r in fit.coefficients.collect()}
    assert coef["(Intercept)"]["estimate"] == pytest.approx(0.4, abs=0.06)
    assert coef["regionRSC"]["estimate"] == pytest.approx(0.7, abs=0.08) and coef["x"]["p_value"] < 1e-6
    assert fit.dispersion == pytest.approx(0.25, abs=0.04)
    used, _ = models.with_terms(df, {"region": ["ACC", "RSC"]}, ["x"])
    mu = F.exp(fit.linear_predictor())
    res = models.simulated_residuals(used, "y", mu, fit.dispersion, "key").withColumn("all", F.lit(1))
    assert models.uniformity_test(res, ["all"]).first()["p"] > 0.01
    d = models.dispersion_test(used, "y", mu, fit.dispersion, "key").first()
    assert d["dispersion_ratio"] == pytest.approx(1, abs=0.1) and d["p"] > 0.01
    a = {r["key"]: r["residual"] for r in res.collect()}
    b = {r["key"]: r["residual"] for r in models.simulated_residuals(used.repartition(11), "y", mu, fit.dispersion, "key").collect()}
    assert a == b
    with pytest.raises(ValueError, match="not positive"):
        models.gamma_glm(df.withColumn("y", F.when(F.col("key") == "k3", -1.0).otherwise(F.col("y"))), "y", {"region": ["ACC", "RSC"]}, ["x"])


def test_level_limit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(models, "DENSE_LEVELS", 2)
    df = spark.createDataFrame([(i % 4, str(i % 5), float(i)) for i in range(40)], "g int, h string, y double")
    with pytest.raises(ValueError, match="more than 2"):
        models.mixed_model(df, "y", {}, [], "g", "h")


def crossed_reml(x, y, groups, crossed, at):
    """REML criterion of a crossed model by the whole covariance matrix; ``at``: relative deviations."""
    z1, z2 = (np.equal.outer(c, np.unique(c)).astype(float) for c in (groups, crossed))
    v = np.eye(len(y)) + at[0] ** 2 * z1 @ z1.T + at[1] ** 2 * z2 @ z2.T
    w = np.linalg.solve(v, x)
    beta = np.linalg.solve(x.T @ w, w.T @ y)
    e = y - x @ beta
    dof = len(y) - x.shape[1]
    s2 = float(e @ np.linalg.solve(v, e)) / dof
    return dof * np.log(2 * np.pi * s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(x.T @ w)[1] + dof, beta


def test_crossed_model_with_many_group_sizes(spark):
    rng = np.random.default_rng(12)
    sizes = [*range(1, 41), 75, 130]  # 42 distinct sizes
    g = np.repeat(np.arange(len(sizes)), sizes)
    h = rng.integers(0, 60, len(g))
    x = rng.normal(size=len(g))
    y = 1 + 0.5 * x + rng.normal(0, 1.2, len(sizes))[g] + rng.normal(0, 0.8, 60)[h] + rng.normal(0, 1, len(g))
    rows = [(int(a), f"h{b:02d}", float(c), float(d)) for a, b, c, d in zip(g, h, x, y)]
    fit = models.mixed_model(spark.createDataFrame(rows, "g int, h string, x double, y double"), "y", {}, ["x"], "g", "h")
    design = np.column_stack([np.ones(len(y)), x])
    at = np.array([fit.sd_groups["g"], fit.sd_groups["h"]]) / fit.sigma
    best, beta = crossed_reml(design, y, g, h, at)
    assert abs(best - fit.reml) < 1e-6 * abs(best) and np.allclose(beta, fit.beta, atol=1e-6)
    for step in ((0.02, 0), (-0.02, 0), (0, 0.02), (0, -0.02)):
        assert crossed_reml(design, y, g, h, at + step)[0] > best


def test_size_basis_gives_every_weight():
    for least, most in ((1.0, 5.0), (1.0, 1e5), (40.0, 3e7)):
        basis = models.SizeBasis(least, most)
        n = np.unique(np.round(np.geomspace(least, most, 77)))
        table = ((basis.ratios + most) / (most * (basis.ratios + n[:, None]))) @ basis.v.T
        for ratio in (1e-6, 1e-3, 0.7, 12.0, 1e4, 1e9):
            share = n / (ratio + n)  # what a group takes off, of the most it can
            assert np.abs(n * (table @ basis.coefficients(ratio)) - share).max() < 1e-11 * share.max()


def test_two_way_anova_of_many_unbalanced_levels(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 90, 2500), rng.geometric(0.03, 2500) % 110
    y = rng.normal(size=2500) + 0.3 * (a % 7) - 0.2 * (b % 5)
    rows = [(f"a{i}", f"b{j}", float(v)) for i, j, v in zip(a, b, y)]
    got = {r.term: r for r in models.two_way_anova(spark.createDataFrame(rows, "a string, b string, y double"), "y", "a", "b").collect()}
    dummy = lambda c: np.equal.outer(c, np.unique(c)).astype(float)
    rss = lambda m: float(np.sum((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2))
    one = np.ones((len(y), 1))
    r0, ra, rab, rfull = rss(one), rss(dummy(a)), rss(np.hstack([dummy(a), dummy(b)])), rss(dummy(a * 1000 + b))
    for term, want in (("a", r0 - ra), ("b", ra - rab), ("a:b", rab - rfull), ("Residuals", rfull)):
        assert abs(got[term].sumsq - want) < 1e-7 * r0
    one_level = models.two_way_anova(spark.createDataFrame([("x", j, v) for _, j, v in rows], "a string, b string, y double"), "y", "a", "b").collect()
    assert abs(one_level[1].sumsq - (r0 - rss(dummy(b)))) < 1e-7 * r0


@pytest.mark.parametrize("shape", [0.3, 1.0, 7.5])
def test_keyed_gamma_has_its_moments(shape):
    keys = np.random.default_rng(2).integers(0, 2**63, (400, 500)).astype(np.uint64)
    x = models.keyed_gamma(keys, shape)
    n = x.size
    assert abs(x.mean() - shape) < 5 * np.sqrt(shape / n)
    assert abs(x.var() - shape) < 5 * np.sqrt((2 * shape**2 + 6 * shape) / n)
    assert (x == models.keyed_gamma(keys, shape)).all()
    if shape == 1.0:
        assert abs((x < 1).mean() - (1 - np.exp(-1))) < 5 * 0.5 / np.sqrt(n)
