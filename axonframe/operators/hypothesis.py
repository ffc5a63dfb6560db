"""Grouped hypothesis tests and effect sizes.

Spark reduces each group to counts, sums and rank sums; p-values and intervals are computed by
Arrow functions on the one-row-per-group result. ``by`` names at least one key.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from axonframe.functions import dist
from axonframe.functions.scalar import ratio
from axonframe.operators.attach import attach, null_safe_join
from axonframe.operators.ordered import CHUNK_ROWS, _with_chunks, average_ranks, cumulative, distinct_counts
from axonframe.operators.pair import level_pairs
from axonframe.operators.reshape import pivot_wider
from axonframe.session import durable


def cor_test(df: DataFrame, by: list[str], x: str, y: str, level: float = 0.95) -> DataFrame:
    """Pearson r, t, df, p and Fisher-z interval; pairs with a missing side are left out."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = both.groupBy(*by).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    r, n = F.col("r"), F.col("n")
    half = F.when(n > 3, dist.normal_critical(level) / F.sqrt(n - 3))
    s = s.withColumn("df", n - 2).withColumn("t", F.when(n > 2, r * F.sqrt(ratio(n - 2, 1 - r * r))))
    return s.select(
        *by, "r", "n", "df", "t",
        dist.t_p_value("t", F.col("df").cast("double")).alias("p"),
        F.tanh(F.atanh(r) - half).alias("ci_low"),
        F.tanh(F.atanh(r) + half).alias("ci_high"),
    )


def t_test_1samp(df: DataFrame, by: list[str], value: str, mu: float = 0.0) -> DataFrame:
    """mean, t, df, p and 95 % interval against ``mu``."""
    s = df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("n")
    )
    sem = F.col("_sd") / F.sqrt(F.col("n"))
    s = (
        s.withColumn("df", F.col("n") - 1)
        .withColumn("t", ratio(F.col("mean") - mu, sem))
        .withColumn("_half", dist.t_half_width(sem, F.col("n")))
    )
    return s.select(
        *by, "mean", "n", "df", "t",
        dist.t_p_value("t", F.col("df").cast("double")).alias("p"),
        (F.col("mean") - F.col("_half")).alias("ci_low"),
        (F.col("mean") + F.col("_half")).alias("ci_high"),
    )


def t_test_paired(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """n_pairs, both means, mean difference a - b, t, df and p."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b))
    s = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
        F.avg("_d").alias("estimate"),
        F.stddev_samp("_d").alias("_sd"),
    )
    s = s.withColumn("df", F.col("n_pairs") - 1).withColumn(
        "t", ratio("estimate", F.col("_sd") / F.sqrt(F.col("n_pairs")))
    )
    return s.withColumn("p", dist.t_p_value("t", F.col("df").cast("double"))).drop("_sd")


def _corrected_z(excess: Column, sigma: Column) -> Column:
    """Continuity-corrected standard score."""
    return ratio(excess - F.signum(excess) * 0.5, sigma)


def rank_sum(
    df: DataFrame, by: list[str], value: str, group: str, a, b, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Wilcoxon rank-sum test of level ``a`` against ``b``.

    Exact p for groups under 50 without ties, else normal with continuity and tie correction.
    """
    d = (
        df.filter(F.col(value).isNotNull() & F.col(group).isin(a, b))
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(group) == F.lit(a), 1)).alias("_na"))
    )
    ranked = average_ranks(d, by, value, chunk_rows)
    n = F.col("n").cast("double")
    s = ranked.groupBy(*by).agg(
        F.sum("_na").alias("n_a"),
        F.sum(F.col("n") - F.col("_na")).alias("n_b"),
        F.sum(F.col("_na") * F.col("avg_rank")).alias("_ra"),
        F.sum(n * n * n - n).alias("ties"),
    )
    m, k = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    total = m + k
    sigma = F.sqrt(m * k / 12 * (total + 1 - ratio("ties", total * (total - 1))))
    s = s.withColumn("w", F.col("_ra") - m * (m + 1) / 2).withColumn("z", _corrected_z(F.col("w") - m * k / 2, sigma))
    exact = (F.col("n_a") < 50) & (F.col("n_b") < 50) & (F.col("ties") == 0)
    s = s.withColumn("exact", exact)
    when_exact = lambda c: F.when(F.col("exact"), c)
    p_exact = dist.rank_sum_p_exact(when_exact(F.col("w")), when_exact(m), when_exact(k))
    return s.withColumn("p", F.when(F.col("exact"), p_exact).otherwise(dist.normal_p_value("z"))).drop("_ra")


def signed_rank(df: DataFrame, by: list[str], value: str, mu: float = 0.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Wilcoxon signed-rank test of ``value`` against ``mu``: normal p with continuity and tie
    correction, rank-biserial effect and its Fisher-z interval. Zero differences are left out."""
    d = (
        df.withColumn("_d", F.col(value) - F.lit(float(mu)))
        .filter("_d IS NOT NULL AND _d <> 0")
        .withColumn("_abs", F.abs("_d"))
        .groupBy(*by, "_abs")
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_d") > 0, 1)).alias("_np"))
    )
    ranked = average_ranks(d, by, "_abs", chunk_rows)
    k = F.col("n").cast("double")
    s = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("_np") * F.col("avg_rank")).alias("v"),
        F.sum((F.col("n") - F.col("_np")) * F.col("avg_rank")).alias("v_minus"),
        F.sum(k * k * k - k).alias("ties"),
    )
    n = F.col("n").cast("double")
    sigma = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    s = s.withColumn("z", _corrected_z(F.col("v") - n * (n + 1) / 4, sigma))
    effect = ratio(F.col("v") - F.col("v_minus"), F.col("v") + F.col("v_minus"))
    se = F.sqrt((2 * n * n * n + 3 * n * n + n) / 6) / ((n * n + n) / 2)
    half = se * dist.normal_critical()
    return s.withColumns(
        {
            "p": dist.normal_p_value("z"),
            "effect": effect,
            "effect_low": F.tanh(F.atanh(effect) - half),
            "effect_high": F.tanh(F.atanh(effect) + half),
        }
    )


def signed_rank_interval(df: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Confidence limits and pseudo-median of the signed-rank test: order statistics of the Walsh averages.

    The limits are the averages (of every pair, and every value with itself) at the positions where the
    normal form of the statistic meets its bounds; the pseudo-median is the median of all averages. They
    are exact for groups of any size and any unit: shifts narrow a bracket around each position (a
    counted pass over the distinct values each), until few averages are left in it to list.
    """
    crit = dist.normal_critical(level)
    values = durable(distinct_counts(df.select(*by, F.col(value).cast("double").alias("_x")), by, "_x"))
    return _walsh_quantiles(values, by, crit)


LONGS = ArrayType(LongType())
WALSH_SHIFTS = 16  # shifts tried in a pass
WALSH_LISTED = 20_000  # averages left in a bracket that are listed
WALSH_PIECE = 2048  # values of a group that are handled together


def _walsh_quantiles(values: DataFrame, by: list[str], crit: float) -> DataFrame:
    """``values``: (by, _x, n). The state is one small row per group and position."""
    n = F.sum("n").cast("double")
    g = values.groupBy(*by).agg(n.alias("_k"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    k = F.col("_k")
    mean, sd, pairs = k * (k + 1) / 4, F.sqrt(k * (k + 1) * (2 * k + 1) / 24), k * (k + 1) / 2
    place = lambda c: F.least(F.greatest(F.rint(c), F.lit(0.0)), pairs - 1).cast("bigint")
    spots = {"ci_low": place(mean - crit * sd), "ci_high": place(mean + crit * sd - 1), "_m0": F.floor((pairs - 1) / 2).cast("bigint"), "_m1": F.floor(pairs / 2).cast("bigint")}
    below = F.col("_min") - F.greatest(F.col("_max") - F.col("_min"), F.abs("_min") * 1e-9, F.lit(1e-300))
    state = durable(
        g.select(*by, pairs.cast("bigint").alias("_pairs"), below.alias("_lo"), F.col("_max").alias("_hi"), F.inline(F.array(*[F.struct(F.lit(w).alias("_which"), c.alias("_r")) for w, c in spots.items()])))
        .withColumn("_at_lo", F.lit(0).cast("bigint")).withColumn("_at_hi", F.col("_pairs"))
    )
    shift = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (i / WALSH_SHIFTS)
    room = (shift(1) > F.col("_lo")) & (shift(WALSH_SHIFTS - 1) < F.col("_hi"))
    wide = (F.col("_at_hi") - F.col("_at_lo") > WALSH_LISTED) & room
    pieces = _walsh_pieces(values, by) if not state.filter(wide).isEmpty() else None
    while not state.filter(wide).isEmpty():
        tried = F.explode(F.transform(F.sequence(F.lit(1), F.lit(WALSH_SHIFTS - 1)), lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (i / WALSH_SHIFTS)))
        counts = _walsh_at_most(pieces, state.filter(wide).select(*by, tried.alias("_t")).distinct(), by)
        steps = null_safe_join(state.filter(wide), counts.groupBy(*by).agg(F.collect_list(F.struct("_t", "_c")).alias("_s")), by, "left")
        inside = F.filter("_s", lambda x: (x["_t"] > F.col("_lo")) & (x["_t"] < F.col("_hi")))
        low = F.array_max(F.filter(inside, lambda x: x["_c"] <= F.col("_r")))
        high = F.array_min(F.filter(inside, lambda x: x["_c"] > F.col("_r")))
        moved = steps.withColumn("_a", low).withColumn("_b", high)
        moved = moved.select(
            *by, "_pairs", F.coalesce("_a._t", "_lo").alias("_lo"), F.coalesce("_b._t", "_hi").alias("_hi"), "_which", "_r", F.coalesce("_a._c", "_at_lo").alias("_at_lo"), F.coalesce("_b._c", "_at_hi").alias("_at_hi")
        )
        state = durable(state.filter(~wide).unionByName(moved))
    listed = _walsh_between(values, state.filter(F.col("_at_hi") - F.col("_at_lo") <= WALSH_LISTED), by)
    at = W.partitionBy(*by, "_which").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    found = listed.groupBy(*by, "_which", "_r", "_at_lo", "_v").agg(F.sum("_n").alias("_n")).withColumn("_c", F.col("_at_lo") + F.sum("_n").over(at))
    found = found.filter(F.col("_c") > F.col("_r")).groupBy(*by, "_which").agg(F.min("_v").alias("_v"))
    # a bracket without room between its ends holds copies of one average
    tied = state.filter(F.col("_at_hi") - F.col("_at_lo") > WALSH_LISTED).select(*by, "_which", F.col("_hi").alias("_v"))
    names = ["ci_low", "ci_high", "_m0", "_m1"]
    out = pivot_wider(found.unionByName(tied), by, "_which", "_v", names, names)
    return out.withColumn("pseudo_median", (F.col("_m0") + F.col("_m1")) / 2).drop("_m0", "_m1")


def _walsh_pieces(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, _p, _first, _last, _before, _all, _xs, _ns): each group's values in order, in numbered runs of at most
    ``WALSH_PIECE``, with the number of rows before a run and of all."""
    run = cumulative(values, by, "_x").withColumn("_run", F.floor(F.col("cum_before") / WALSH_PIECE))
    items = F.array_sort(F.collect_list(F.struct("_x", "n")))
    runs = run.groupBy(*by, "_run").agg(items.alias("_i"), F.min("_x").alias("_first"), F.max("_x").alias("_last"), F.min("cum_before").alias("_before"), F.max("total").alias("_all"))
    number = (F.row_number().over(W.partitionBy(*by).orderBy("_run")) - 1).cast("bigint")
    heads = runs.select(*by, "_run", number.alias("_p"))  # the order is taken without the values
    named = null_safe_join(runs, heads, [*by, "_run"])
    return durable(named.select(*by, "_p", "_first", "_last", "_before", "_all", F.col("_i._x").alias("_xs"), F.col("_i.n").alias("_ns")))


@pandas_udf(LONGS)
def _pairs_up_to(xs: pd.Series, ns: pd.Series, ys: pd.Series, ms: pd.Series, ts: pd.Series) -> pd.Series:
    """Per shift t, the ordered pairs of two runs with ``y <= 2t - x``."""

    def one(x, n, y, m, t):
        upto = np.concatenate([[0], np.cumsum(m)])
        return [int(np.dot(n, upto[np.searchsorted(y, 2 * v - x, "right")])) for v in t]

    return pd.Series([one(*row) for row in zip(xs, ns, ys, ms, ts)])


@pandas_udf(LONGS)
def _selves_up_to(xs: pd.Series, ns: pd.Series, ts: pd.Series) -> pd.Series:
    """Per shift t, the rows of a run with ``x <= 2t - x``."""
    return pd.Series([[int(n[~(x > 2 * v - x)].sum()) for v in t] for x, n, t in zip(xs, ns, ts)])


def _walsh_at_most(pieces: DataFrame, shifts: DataFrame, by: list[str]) -> DataFrame:
    """(by, _t, _c): Walsh averages up to ``_t``. Of the ordered pairs those with ``y <= 2t - x`` are counted, then
    each pair once and each value with itself. For a run of x, all runs below ``2t - x`` count as a whole; those that
    it crosses, two per run on average, meet it."""
    heads = pieces.select(*by, "_p", "_first", "_last", "_before", "_all", F.aggregate("_ns", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("_rows"))
    tried = shifts.groupBy(*by).agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    asked = null_safe_join(heads, tried, by).select(*by, "_p", "_first", "_last", "_all", "_rows", F.explode("_ts").alias("_t"))
    none, no = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    # ends of runs and the questions in one order: runs that end before 2t - last, and that start up to 2t - first
    line = lambda d, z, kind, end, start, rows, q, t: d.select(*by, z.alias("_z"), F.lit(kind).alias("_kind"), end.alias("_end"), start.alias("_start"), rows.alias("_rows"), q.alias("_q"), t.alias("_at"))
    one, nan = F.lit(1).cast("bigint"), F.lit(None).cast("double")
    marks = [
        line(asked, 2 * F.col("_t") - F.col("_last"), 0, none, none, none, F.col("_p"), F.col("_t")),
        line(heads, F.col("_last"), 1, one, none, F.col("_rows"), no, nan),
        line(heads, F.col("_first"), 2, none, one, none, no, nan),
        line(asked, 2 * F.col("_t") - F.col("_first"), 3, none, none, none, F.col("_p"), F.col("_t")),
    ]
    order = W.partitionBy(*by).orderBy("_z", "_kind").rowsBetween(W.unboundedPreceding, 0)
    seen = reduce(DataFrame.unionByName, marks).select(*by, "_kind", "_q", "_at", *[F.sum(c).over(order).alias(c) for c in ("_end", "_start", "_rows")])
    met = seen.filter("_q IS NOT NULL").groupBy(*by, F.col("_q").alias("_p"), F.col("_at").alias("_t")).agg(
        F.max(F.when(F.col("_kind") == 0, F.col("_end"))).alias("_from"), F.max(F.when(F.col("_kind") == 0, F.col("_rows"))).alias("_below"),
        F.max(F.when(F.col("_kind") == 3, F.col("_start"))).alias("_to"),
    )
    met = durable(null_safe_join(met, heads.select(*by, "_p", F.col("_rows").alias("_n")), [*by, "_p"]))
    whole = met.select(*by, "_t", (F.col("_n") * F.col("_below")).alias("_c"))
    crossed = met.filter("_from < _to").withColumn("_o", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)))
    crossed = crossed.groupBy(*by, "_p", "_o").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    data = pieces.select(*by, "_p", "_xs", "_ns")
    left = null_safe_join(crossed, data, [*by, "_p"])
    both = null_safe_join(left, data.select(*by, F.col("_p").alias("_o"), F.col("_xs").alias("_ys"), F.col("_ns").alias("_ms")), [*by, "_o"])
    parts = both.select(*by, "_ts", _pairs_up_to("_xs", "_ns", "_ys", "_ms", "_ts").alias("_cs"))
    own = null_safe_join(pieces, tried, by).select(*by, "_ts", _selves_up_to("_xs", "_ns", "_ts").alias("_cs"))
    counted = parts.unionByName(own).select(*by, F.inline(F.arrays_zip(F.col("_ts").alias("_t"), F.col("_cs").alias("_c"))))
    return whole.unionByName(counted.select(*by, "_t", "_c")).groupBy(*by, "_t").agg((F.sum(F.col("_c").cast("decimal(38,0)")) / 2).cast("bigint").alias("_c"))


def _walsh_between(values: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """The averages in (lo, hi] of each bracket with their number; values meet on buckets as wide as twice
    the bracket, so a value looks into three of them."""
    keys = [*by, "_which"]
    span = brackets.select(*keys, "_lo", "_hi", "_r", "_at_lo", (2 * (F.col("_hi") - F.col("_lo"))).alias("_w"))
    x = null_safe_join(values, span, by)
    bucket = lambda c: F.floor(c / F.col("_w"))
    left = x.withColumn("_b", F.explode(F.sequence(bucket(2 * F.col("_lo") - F.col("_x")) - 1, bucket(2 * F.col("_hi") - F.col("_x")) + 1)))
    right = x.select(*keys, F.col("_x").alias("_y"), F.col("n").alias("_ny"), bucket(F.col("_x")).alias("_b"))
    met = null_safe_join(left, right, [*keys, "_b"]).filter("_y >= _x AND _y > 2 * _lo - _x AND NOT _y > 2 * _hi - _x")
    pairs = F.when(F.col("_x") == F.col("_y"), F.col("n") * (F.col("n") + 1) / 2).otherwise(F.col("n") * F.col("_ny")).cast("bigint")
    return met.select(*keys, "_r", "_at_lo", ((F.col("_x") + F.col("_y")) / 2).alias("_v"), pairs.alias("_n"))


def friedman(df: DataFrame, by: list[str], subject: list[str], level: str, value: str, levels: list) -> DataFrame:
    """Friedman chi2, df, p and Kendall's W over the complete subjects.

    Ranks within a subject come from comparing its k columns: one shuffle, no sort.
    """
    k = len(levels)
    cols = [f"_v{i}" for i in range(k)]
    wide = pivot_wider(df, [*by, *subject], level, value, levels, cols).dropna(subset=cols)

    def count(cond) -> Column:
        return sum((F.when(c, 1).otherwise(0) for c in cond), F.lit(0))

    less = [count([F.col(o) < F.col(c) for o in cols]) for c in cols]
    same = [count([F.col(o) == F.col(c) for o in cols]) for c in cols]
    ranks = [(lo + (eq + 1) / F.lit(2.0)).alias(f"_r{i}") for i, (lo, eq) in enumerate(zip(less, same))]
    tie = sum((eq * eq - 1 for eq in same), F.lit(0)).alias("_tie")
    s = wide.select(*by, *ranks, tie).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_tie").alias("_ties"), *[F.sum(f"_r{i}").alias(f"_s{i}") for i in range(k)]
    )
    n = F.col("n").cast("double")
    ss = sum(((F.col(f"_s{i}") - n * (k + 1) / 2) * (F.col(f"_s{i}") - n * (k + 1) / 2) for i in range(k)), F.lit(0.0))
    s = s.withColumn("chi2", ratio(12 * ss, n * k * (k + 1) - F.col("_ties") / (k - 1))).withColumn("df", F.lit(k - 1))
    return s.select(
        *by, "n", "chi2", "df",
        dist.chi2_p_value("chi2", F.col("df").cast("double")).alias("p"),
        ratio("chi2", n * (k - 1)).alias("kendalls_w"),
    )


def pairwise_signed_rank(df: DataFrame, by: list[str], subject: list[str], level: str, value: str, levels: list) -> DataFrame:
    """Signed-rank tests of all level pairs over the same subjects, BH-adjusted within ``by``."""
    pairs = level_pairs(df, [*by, *subject], level, value, levels)
    pairs = pairs.withColumn("_diff", F.col("value_a") - F.col("value_b"))
    # a few rows, used several times by the adjustment
    tests = durable(signed_rank(pairs, [*by, "level_a", "level_b"], "_diff"))
    return benjamini_hochberg(tests, by, "p", "p_adj")


def hedges_g(df: DataFrame, by: list[str], value: str, mu: float = 0.0, level: float = 0.95) -> DataFrame:
    """One-sample Hedges g with a non-central t interval."""
    s = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("n"))
    df_ = (F.col("n") - 1).cast("double")
    root = F.sqrt(F.col("n"))
    s = (
        s.withColumn("d", ratio(F.col("_m") - mu, "_sd"))
        .withColumn("_j", dist.hedges_j(df_))
        .withColumn("_ci", dist.noncentral_t_interval(F.col("d") * root, df_, F.lit(level)))
    )
    return s.select(
        *by, "n", "d", (F.col("d") * F.col("_j")).alias("g"),
        (F.col("_ci.low") / root * F.col("_j")).alias("g_low"),
        (F.col("_ci.high") / root * F.col("_j")).alias("g_high"),
    )


def t_to_d(df: DataFrame, t: str, dof: str, paired: bool = True, level: float = 0.95) -> DataFrame:
    """Add d and its interval, from a t statistic and its degrees of freedom."""
    factor = F.lit(1.0 if paired else 2.0) / F.sqrt(F.col(dof))
    ci = dist.noncentral_t_interval(F.col(t), F.col(dof).cast("double"), F.lit(level))
    return (
        df.withColumn("_ci", ci)
        .withColumns({"d": F.col(t) * factor, "d_low": F.col("_ci.low") * factor, "d_high": F.col("_ci.high") * factor})
        .drop("_ci")
    )


def benjamini_hochberg(
    df: DataFrame, family: list[str], p: str = "p", name: str = "p_adj", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Adjusted p-values within each test family; a missing p stays missing and is not counted."""
    by = family or ["_all"]
    src = df if family else df.withColumn("_all", F.lit(0))
    c = cumulative(distinct_counts(src, by, p), by, p, chunk_rows=chunk_rows)
    c = c.withColumn("_raw", F.col(p) * F.col("total") / (F.col("cum_before") + F.col("n"))).select(*by, p, "_raw")
    chunked = _with_chunks(c, by, p, chunk_rows)
    if chunked is None:
        later = W.partitionBy(*by).orderBy(F.col(p).desc()).rowsBetween(W.unboundedPreceding, 0)
        adj = c.withColumn(name, F.least(F.min("_raw").over(later), F.lit(1.0)))
    else:
        tail = W.partitionBy(*by).orderBy(F.col("_chunk").desc()).rowsBetween(W.unboundedPreceding, -1)
        mins = chunked.groupBy(*by, "_chunk").agg(F.min("_raw").alias("_m")).withColumn("_later", F.min("_m").over(tail)).drop("_m")
        inside = W.partitionBy(*by, "_chunk").orderBy(F.col(p).desc()).rowsBetween(W.unboundedPreceding, 0)
        adj = null_safe_join(chunked, mins, [*by, "_chunk"]).withColumn(
            name, F.least(F.min("_raw").over(inside), F.col("_later"), F.lit(1.0))
        )
    return null_safe_join(src, adj.select(*by, p, name), [*by, p], "left").drop("_all")
