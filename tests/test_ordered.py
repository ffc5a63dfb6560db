"""Ranks, quantiles and adjustments must not depend on how large groups are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import hypothesis, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value holds a third of them; one group key is NULL."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 400, 2000)] + [("hot", 7.0)] * 1000
    rows += [("cold", float(v)) for v in rng.normal(size=50)] + [(None, 1.0), (None, 2.0), ("cold", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(7)


def as_dict(df, key, *values):
    return {tuple(r[k] for k in key): tuple(r[v] for v in values) for r in df.collect()}


def test_average_ranks_with_and_without_chunks(skewed):
    d = ordered.distinct_counts(skewed, ["g"], "v")
    plain = as_dict(ordered.average_ranks(d, ["g"], "v"), ["g", "v"], "avg_rank", "total")
    cut = as_dict(ordered.average_ranks(d, ["g"], "v", chunk_rows=20), ["g", "v"], "avg_rank", "total")
    assert plain == cut
    values = sorted(r["v"] for r in skewed.filter("g = 'hot'").collect())
    first, last = values.index(7.0) + 1, len(values) - values[::-1].index(7.0)
    assert plain["hot", 7.0] == ((first + last) / 2, len(values))


@pytest.mark.parametrize("chunk_rows", [ordered.CHUNK_ROWS, 15])
def test_quantiles(skewed, chunk_rows):
    q = ordered.exact_quantiles(skewed, ["g"], "v", [0.025, 0.5, 0.9], ["a", "b", "c"], chunk_rows)
    got = as_dict(q, ["g"], "a", "b", "c")
    for g in ("hot", "cold"):
        v = [r["v"] for r in skewed.filter(F.col("g") == g).collect() if r["v"] is not None]
        assert got[(g,)] == pytest.approx(tuple(np.quantile(v, [0.025, 0.5, 0.9])))
    assert got[(None,)][1] == 1.5


def test_benjamini_hochberg_by_hand_and_in_chunks(spark):
    p = [0.01, 0.04, 0.03, 0.04, 0.9, None]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "fam string, i int, p double")
    expect = {0: 0.05, 1: 0.05, 2: 0.05, 3: 0.05, 4: 0.9, 5: None}
    for chunk in (ordered.CHUNK_ROWS, 2):
        got = {r["i"]: r["p_adj"] for r in hypothesis.benjamini_hochberg(df, ["fam"], chunk_rows=chunk).collect()}
        assert {k: (v if v is None else round(v, 12)) for k, v in got.items()} == expect
    assert hypothesis.benjamini_hochberg(df.drop("fam"), []).count() == 6


def test_rank_sum_small_exact_and_chunked(spark):
    rows = [("a", v) for v in (1.1, 2.2, 3.3, 4.4)] + [("b", v) for v in (2.5, 3.5, 5.5, 6.5, 7.5)]
    df = spark.createDataFrame([("k", *r) for r in rows], "by string, g string, v double")
    r = hypothesis.rank_sum(df, ["by"], "v", "g", "a", "b").first()
    assert (r["w"], r["exact"]) == (3.0, True)
    assert r["p"] == pytest.approx(0.1111111111, abs=1e-9)
    assert hypothesis.rank_sum(df, ["by"], "v", "g", "a", "b", chunk_rows=3).first()["w"] == 3.0


def walsh(x, level_z=1.959963984540054):
    x = np.sort(np.asarray(x))
    i, j = np.triu_indices(len(x))
    w, n = np.sort((x[i] + x[j]) / 2), len(x)
    mean, sd = n * (n + 1) / 4, np.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    pick = lambda v: w[min(max(round(v), 0), len(w) - 1)]
    return pick(mean - level_z * sd), pick(mean + level_z * sd - 1), np.median(w)


@pytest.mark.parametrize("listed", [hypothesis.WALSH_LISTED, 30])
def test_signed_rank_interval_is_exact_in_any_unit_and_size(spark, monkeypatch, listed):
    monkeypatch.setattr(hypothesis, "WALSH_LISTED", listed)
    rng = np.random.default_rng(21)
    groups = {
        "small": rng.normal(3, 1, 10), "tiny unit": rng.normal(1e-12, 1e-12, 60), "ties": rng.integers(0, 4, 80).astype(float),
        "one": np.array([2.5]), "same": np.full(300, -1.25), "large": rng.normal(-50, 7, 2500) * 1e-5,
    }
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double")
    got = {r["g"]: (r["ci_low"], r["ci_high"], r["pseudo_median"]) for r in hypothesis.signed_rank_interval(df, ["g"], "v").collect()}
    for g, x in groups.items():
        assert got[g] == pytest.approx(walsh(x), rel=1e-9), g


def test_walsh_counts_meet_run_by_run(spark, monkeypatch):
    """A shift asks each run of values for the few runs it crosses; no row for every value and shift."""
    monkeypatch.setattr(hypothesis, "WALSH_PIECE", 16)
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(0, 1, 700), "b": rng.integers(-3, 4, 500).astype(float), None: np.concatenate([rng.normal(9, 2, 90), np.full(60, 9.0)])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, _x double")
    pieces = hypothesis._walsh_pieces(ordered.distinct_counts(df, ["g"], "_x"), ["g"])
    assert pieces.select(F.max(F.size("_xs"))).first()[0] <= 16
    tried = {g: [float(t) for t in (x.min() - 1, *np.quantile(x, [0.01, 0.3, 0.5, 0.8]), x.max())] for g, x in groups.items()}
    shifts = spark.createDataFrame([(g, t) for g, ts in tried.items() for t in set(ts)], "g string, _t double")
    got = {(r["g"], r["_t"]): r["_c"] for r in hypothesis._walsh_at_most(pieces, shifts, ["g"]).collect()}
    for g, x in groups.items():
        x = np.sort(x)
        i, j = np.triu_indices(len(x))
        for t in set(tried[g]):
            assert got[g, t] == np.count_nonzero(~(x[j] > 2 * t - x[i])), (g, t)


def test_one_exploded_group_is_cut(spark):
    """Size estimates do not see what an explode adds; the rows are counted."""
    d = spark.range(40).select(F.lit("g").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"), F.col("id")).select("g", (F.col("id") * 100 + F.col("i")).cast("double").alias("v"))
    c = ordered.cumulative(ordered.distinct_counts(d, ["g"], "v"), ["g"], "v", chunk_rows=1000)
    assert "_chunk" in c._jdf.queryExecution().toString()
    assert c.agg(F.max("cum_before")).first()[0] == 3999
