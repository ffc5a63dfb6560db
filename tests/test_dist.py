"""Distribution functions against commons-math3 and known values."""

import math

import numpy as np
import pytest

from axonframe.functions import dist


@pytest.fixture(scope="module")
def cm(spark):
    return spark._jvm.org.apache.commons.math3.distribution


@pytest.mark.parametrize("df", [1, 2.5, 9, 40, 3000])
def test_t(cm, df):
    d = cm.TDistribution(float(df))
    for t in (0.0, 0.3, 1.7, 5.0):
        assert float(dist.t_cdf(t, df)) == pytest.approx(d.cumulativeProbability(t), abs=1e-9)
    for p in (0.025, 0.5, 0.975, 0.9999):
        assert float(dist.t_quantile(p, df)) == pytest.approx(d.inverseCumulativeProbability(p), rel=1e-6, abs=1e-8)


@pytest.mark.parametrize("d1,d2", [(1, 5), (3, 80), (12, 2)])
def test_f(cm, d1, d2):
    d = cm.FDistribution(float(d1), float(d2))
    for f in (0.1, 1.0, 4.5):
        assert float(dist.f_sf(f, d1, d2)) == pytest.approx(1 - d.cumulativeProbability(f), abs=1e-9)


@pytest.mark.parametrize("df", [1, 4, 25])
def test_chi2(cm, df):
    d = cm.ChiSquaredDistribution(float(df))
    for x in (0.2, 3.0, 30.0):
        assert float(dist.chi2_sf(x, df)) == pytest.approx(1 - d.cumulativeProbability(x), abs=1e-9)


def test_normal():
    assert dist.normal_critical() == pytest.approx(1.959963984540054, abs=1e-12)


def test_noncentral_t_is_the_distribution_of_a_shifted_ratio():
    rng = np.random.default_rng(1)
    df, ncp, t = 8, 1.3, 2.0
    draws = (rng.standard_normal(400_000) + ncp) / np.sqrt(rng.chisquare(df, 400_000) / df)
    assert dist.nct_cdf(t, df, ncp) == pytest.approx(float((draws <= t).mean()), abs=4e-3)
    low, high = dist.nct_limits(t, df)
    assert dist.nct_cdf(t, df, low) == pytest.approx(0.975, abs=1e-8)
    assert dist.nct_cdf(t, df, high) == pytest.approx(0.025, abs=1e-8)

@pytest.mark.parametrize("df", [10, 12.5, 60, 900])
@pytest.mark.parametrize("ncp", [-3.0, 0.0, 0.4, 7.0, 90.0])
def test_noncentral_t_by_nodes_is_its_series(df, ncp):
    for t in (0.01, 0.3, 2.0, 80.0, 100.0):
        assert dist.nct_cdf(t, df, ncp) == pytest.approx(dist._nct_series(t, df, ncp), abs=1e-10)


@pytest.mark.parametrize("n", [2_000, 540_000, 5_000_000_000])
@pytest.mark.parametrize("d", [0.001, 2.2, 300.0])
def test_noncentral_t_limits_take_the_same_work_for_any_group_size(monkeypatch, n, d):
    handled = []
    for name in ("_erfc", "_lgamma"):
        fn = getattr(dist, name)
        monkeypatch.setattr(dist, name, lambda x, fn=fn: handled.append(np.size(x)) or fn(x))
    t = d * math.sqrt(n)
    low, high = dist.nct_limits(t, n - 1.0)
    assert sum(handled) < 100_000
    sd = math.sqrt(1 + d * d / 2)  # of the statistic, for large n
    for limit, z in ((low, -1.959963984540054), (high, 1.959963984540054)):
        assert (limit - t) / sd == pytest.approx(z, abs=0.1)
    assert dist.nct_cdf(t, n - 1.0, low) == pytest.approx(0.975, abs=1e-8)
    assert dist.nct_cdf(t, n - 1.0, high) == pytest.approx(0.025, abs=1e-8)



def test_exact_rank_tests_against_enumeration():
    from itertools import combinations

    m, n = 4, 5
    us = [sum(c) - m * (m + 1) // 2 for c in combinations(range(1, m + n + 1), m)]
    for w in (2, 7, 14):
        tail = min(sum(u <= w for u in us), sum(u >= w for u in us)) / len(us)
        assert dist.rank_sum_exact_p(w, m, n) == pytest.approx(min(1, 2 * tail))


def test_hedges_factor():
    assert float(dist.hedges_correction(10)) == pytest.approx(1 - 3 / (4 * 10 - 1), abs=2e-3)
    assert math.isfinite(float(dist.hedges_correction(1e6)))
