"""Tests and effect sizes; the SQL computes p-values by numerical integration."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonframe.operators import hypothesis
from suite.base import b, big, num, query, r
from suite.summaries import COND_SQL, cell_conditions, t_quantile_sql
from suite.surrogates import INTERVALS, surrogate, with_

NODES = 2000  # Simpson intervals


def _simpson(f: str, top: str) -> str:
    """Integral of f(u) over [0, top]; ``f`` uses {u}."""
    u = f"(k * ({top}) / {NODES}e0)"
    w = f"(CASE WHEN k = 0 OR k = {NODES} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(({top}) / {3 * NODES}e0 * list_sum([{w} * ({f.format(u=u)}) for k in range(0, {NODES + 1})]))"


def t_p_sql(t: str, df: str) -> str:
    body = _simpson(f"pow(cos({{u}}), ({df}) - 1e0)", f"atan(abs({t}) / sqrt({df}))")
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2e0) - lgamma(({df}) / 2e0)) / sqrt(pi()) * {body})"


def normal_p_sql(z: str) -> str:
    return f"(1 - 2 / sqrt(2 * pi()) * {_simpson('exp(-{u} * {u} / 2)', f'least(abs({z}), 40)')})"


def peaks(spark, sf):
    return surrogate(spark, sf, "peaks")


def cells(spark, sf):
    return peaks(spark, sf).groupBy("cell", "interval_s").agg((F.avg("actual_peak") / 20).alias("v"))


CELL_SQL = "SELECT cell, interval_s, avg(actual_peak) / 20 AS v FROM peaks GROUP BY 1, 2"


@query(
    "t1_cor_test",
    with_(
        "ei",
        s="SELECT region, corr(amp_plus10, rough_ap) AS r, count(*) AS n FROM ei WHERE amp_plus10 IS NOT NULL AND rough_ap IS NOT NULL GROUP BY 1",
        t="SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM s",
        then=f"SELECT region, {r('r')} AS r, {b('n')} AS n, {r('t', 5)} AS t, {r(t_p_sql('t', '(n - 2e0)'), 5)} AS p,"
        f" {r('tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3))')} AS ci_low, {r('tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3))')} AS ci_high FROM t",
    ),
)
def t1(spark, sf):
    d = hypothesis.cor_test(surrogate(spark, sf, "ei"), ["region"], "amp_plus10", "rough_ap")
    return d.select("region", num("r", "r"), big("n", "n"), num("t", "t", 5), num("p", "p", 5), num("ci_low", "ci_low"), num("ci_high", "ci_high"))


@query(
    "t2_t_test_one_sample",
    with_(
        "peaks",
        c=CELL_SQL,
        s="SELECT interval_s, avg(v) AS m, stddev_samp(v) / sqrt(count(v)) AS se, count(v) AS n FROM c GROUP BY 1",
        t="SELECT *, (m - 1) / se AS t FROM s",
        then=f"SELECT interval_s, {b('n')} AS n, {r('m')} AS mean, {r('t', 5)} AS t, {r(t_p_sql('t', '(n - 1e0)'), 5)} AS p,"
        f" {r('m - se * ' + t_quantile_sql('(n - 1e0)'), 5)} AS ci_low, {r('m + se * ' + t_quantile_sql('(n - 1e0)'), 5)} AS ci_high FROM t",
    ),
)
def t2(spark, sf):
    d = hypothesis.t_test_1samp(cells(spark, sf), ["interval_s"], "v", 1.0)
    return d.select("interval_s", big("n", "n"), num("mean", "mean"), num("t", "t", 5), num("p", "p", 5), num("ci_low", "ci_low", 5), num("ci_high", "ci_high", 5))


PAIRS_SQL = "SELECT a.interval_s, a.ei AS x, d.ei AS y FROM (SELECT * FROM c WHERE NOT ptx) a JOIN (SELECT * FROM c WHERE ptx) d USING (cell, interval_s, stim1) WHERE a.ei IS NOT NULL AND d.ei IS NOT NULL"


def drug_pairs(spark, sf):
    from axonframe.operators.pair import pair_join

    return pair_join(cell_conditions(spark, sf), ~F.col("ptx"), F.col("ptx"), ["cell", "interval_s", "stim1"], ["ei"], ("_acsf", "_ptx"))


@query(
    "t3_t_test_paired",
    with_(
        "peaks",
        c=COND_SQL,
        p=PAIRS_SQL,
        s="SELECT interval_s, count(*) AS n, avg(x) AS ma, avg(y) AS mb, avg(x - y) AS est, avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))) AS t FROM p GROUP BY 1",
        then=f"SELECT interval_s, {b('n')} AS n_pairs, {r('ma')} AS mean_acsf, {r('mb')} AS mean_ptx, {r('est')} AS estimate, {r('t', 5)} AS statistic, {b('n - 1')} AS df, {r(t_p_sql('t', '(n - 1e0)'), 5)} AS p FROM s",
    ),
)
def t3(spark, sf):
    d = hypothesis.t_test_paired(drug_pairs(spark, sf), ["interval_s"], "ei_acsf", "ei_ptx")
    return d.select(
        "interval_s", big("n_pairs", "n_pairs"), num("mean_a", "mean_acsf"), num("mean_b", "mean_ptx"), num("estimate", "estimate"),
        num("t", "statistic", 5), big("df", "df"), num("p", "p", 5),
    )


RANK_SUM_SQL = (
    "SELECT {by}, count_if(g) AS na, count_if(NOT g) AS nb, sum(CASE WHEN g THEN rk END) - count_if(g) * (count_if(g) + 1) / 2e0 AS w, sum(tie) AS ties"
    " FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY v) + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2e0 AS rk,"
    " pow(count(*) OVER (PARTITION BY {by}, v), 2) - 1 AS tie FROM d) GROUP BY 1"
)


@query(
    "t4_rank_sum",
    with_(
        "ei",
        d="SELECT opsin, amp_plus10 AS v, region = 'ACC' AS g FROM ei WHERE amp_plus10 IS NOT NULL AND region IS NOT NULL",
        s=RANK_SUM_SQL.format(by="opsin"),
        z="SELECT *, (w - na * nb / 2e0 - sign(w - na * nb / 2e0) * 0.5e0) / sqrt(na * nb / 12e0 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1e0)))) AS z FROM s",
        then=f"SELECT opsin, {b('na')} AS n_a, {b('nb')} AS n_b, {r('w', 1)} AS w, {r('z', 5)} AS z, {r(normal_p_sql('z'), 5)} AS p FROM z",
    ),
)
def t4(spark, sf):
    d = hypothesis.rank_sum(surrogate(spark, sf, "ei"), ["opsin"], "amp_plus10", "region", "ACC", "RSC")
    return d.select("opsin", big("n_a", "n_a"), big("n_b", "n_b"), num("w", "w", 1), num("z", "z", 5), num("p", "p", 5))


SIGNED_SQL = (
    "SELECT {by}, count(*) AS n, coalesce(sum(CASE WHEN dv > 0 THEN rk END), 0) AS v, coalesce(sum(CASE WHEN dv < 0 THEN rk END), 0) AS vm, sum(tie) AS ties"
    " FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY abs(dv)) + (count(*) OVER (PARTITION BY {by}, abs(dv)) - 1) / 2e0 AS rk,"
    " pow(count(*) OVER (PARTITION BY {by}, abs(dv)), 2) - 1 AS tie FROM d) GROUP BY {by}"
)
SIGNED_Z = "(v - n * (n + 1) / 4e0 - sign(v - n * (n + 1) / 4e0) * 0.5e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24e0 - ties / 48e0)"


@query(
    "t5_signed_rank",
    with_(
        "peaks",
        c=CELL_SQL,
        d="SELECT interval_s, v - 1 AS dv FROM c WHERE v <> 1",
        s=SIGNED_SQL.format(by="interval_s"),
        z=f"SELECT *, {SIGNED_Z} AS z FROM s",
        then=f"SELECT interval_s, {b('n')} AS n, {r('v', 1)} AS v, {r('z', 5)} AS z, {r(normal_p_sql('z'), 5)} AS p FROM z",
    ),
)
def t5(spark, sf):
    d = hypothesis.signed_rank(cells(spark, sf), ["interval_s"], "v", 1.0)
    return d.select("interval_s", big("n", "n"), num("v", "v", 1), num("z", "z", 5), num("p", "p", 5))


# Walsh averages of every interval, sorted, and the positions of the limits
WALSH_SQL = {
    "w": "SELECT a.interval_s, (a.v + e.v) / 2 AS m FROM (SELECT *, row_number() OVER () AS i FROM c WHERE v IS NOT NULL) a JOIN (SELECT *, row_number() OVER () AS i FROM c WHERE v IS NOT NULL) e ON a.interval_s = e.interval_s AND a.v <= e.v AND (a.v < e.v OR a.cell <= e.cell)",
    "k": "SELECT interval_s, count(v) AS k FROM c GROUP BY 1",
    "q": "SELECT interval_s, list_sort(list(m)) AS l, any_value(k * (k + 1) / 4e0) AS mean, any_value(1.959963984540054e0 * sqrt(k * (k + 1) * (2 * k + 1) / 24e0)) AS half, any_value(k * (k + 1) // 2) AS p FROM w JOIN k USING (interval_s) GROUP BY 1",
}


@query(
    "t5_signed_rank_interval",
    with_(
        "peaks",
        c=CELL_SQL,
        **WALSH_SQL,
        then=f"SELECT interval_s, {r('l[CAST(round_even(least(greatest(mean - half, 0), p - 1), 0) AS BIGINT) + 1]', 4)} AS ci_low, {r('l[CAST(round_even(least(greatest(mean + half - 1, 0), p - 1), 0) AS BIGINT) + 1]', 4)} AS ci_high,"
        f" {r('(l[(p - 1) // 2 + 1] + l[p // 2 + 1]) / 2', 4)} AS pseudo_median FROM q",
    ),
)
def t5_ci(spark, sf):
    d = hypothesis.signed_rank_interval(cells(spark, sf), ["interval_s"], "v")
    return d.select("interval_s", num("ci_low", "ci_low", 4), num("ci_high", "ci_high", 4), num("pseudo_median", "pseudo_median", 4))


PAIR_DIFF_SQL = {
    "c": CELL_SQL,
    "d": "SELECT a.interval_s AS la, e.interval_s AS lb, a.v - e.v AS dv FROM c a JOIN c e ON a.cell = e.cell AND a.interval_s < e.interval_s WHERE a.v <> e.v",
    "s": SIGNED_SQL.format(by="la, lb"),
    "z": f"SELECT *, {SIGNED_Z} AS z FROM s",
    "p": f"SELECT *, greatest({normal_p_sql('z')}, 0) AS p FROM z",
}
BH_SQL = (
    "least(1, min(p * m / rk) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj"
    " FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS rk FROM {t})"
)


@query(
    "t6_pairwise_signed_rank",
    with_("peaks", **PAIR_DIFF_SQL, then=f"SELECT la AS level_a, lb AS level_b, {b('n')} AS n, {r('v', 1)} AS v, {r('z', 5)} AS z, {r('p', 5)} AS p, {r('p_adj', 5)} AS p_adj FROM (SELECT *, {BH_SQL.format(t='p')})"),
)
def t6(spark, sf):
    d = hypothesis.pairwise_signed_rank(cells(spark, sf).withColumn("all", F.lit(0)), ["all"], ["cell"], "interval_s", "v", INTERVALS)
    return d.select("level_a", "level_b", big("n", "n"), num("v", "v", 1), num("z", "z", 5), num("p", "p", 5), num("p_adj", "p_adj", 5))


FRIEDMAN_SQL = {
    "c": CELL_SQL,
    "ok": "SELECT cell FROM c GROUP BY 1 HAVING count(v) = 5",
    "rk": "SELECT interval_s, rank() OVER (PARTITION BY cell ORDER BY v) + (count(*) OVER (PARTITION BY cell, v) - 1) / 2e0 AS rk, pow(count(*) OVER (PARTITION BY cell, v), 2) - 1 AS tie FROM c SEMI JOIN ok USING (cell)",
    "cs": "SELECT interval_s, sum(rk) AS s, count(*) AS n, sum(tie) AS tie FROM rk GROUP BY 1",
    "f": "SELECT max(n) AS n, 12 * sum(pow(s - n * 3e0, 2)) / (max(n) * 30e0 - sum(tie) / 4e0) AS chi2 FROM cs",
}


def friedman_run(spark, sf):
    d = cells(spark, sf).withColumn("all", F.lit(0))
    return hypothesis.friedman(d, ["all"], ["cell"], "interval_s", "v", INTERVALS)


@query(
    "t7_friedman",
    with_("peaks", **FRIEDMAN_SQL, then=f"SELECT {b('n')} AS n, {r('chi2', 5)} AS chi2, CAST(4 AS BIGINT) AS df, {r('exp(-chi2 / 2) * (1 + chi2 / 2)')} AS p FROM f"),
)
def t7(spark, sf):
    return friedman_run(spark, sf).select(big("n", "n"), num("chi2", "chi2", 5), big("df", "df"), num("p", "p"))


@query("t8_kendalls_w", with_("peaks", **FRIEDMAN_SQL, then=f"SELECT {r('chi2 / (n * 4)')} AS kendalls_w FROM f"))
def t8(spark, sf):
    return friedman_run(spark, sf).select(num("kendalls_w", "kendalls_w"))


@query(
    "t9_hedges_g",
    with_(
        "peaks",
        c=CELL_SQL,
        s="SELECT interval_s, (avg(v) - 1) / stddev_samp(v) AS d, count(v) - 1e0 AS df FROM c GROUP BY 1",
        then=f"SELECT interval_s, {r('d')} AS d, {r('d * exp(lgamma(df / 2) - lgamma((df - 1) / 2)) / sqrt(df / 2)')} AS g FROM s",
    ),
)
def t9(spark, sf):
    return hypothesis.hedges_g(cells(spark, sf), ["interval_s"], "v", 1.0).select("interval_s", num("d", "d"), num("g", "g"))


@query("t9_hedges_g_interval")
def t9_ci(spark, sf):
    d = hypothesis.hedges_g(cells(spark, sf), ["interval_s"], "v", 1.0)
    return d.select("interval_s", num("g", "g"), num("g_low", "g_low"), num("g_high", "g_high"))


@query(
    "t10_rank_biserial",
    with_(
        "peaks",
        c=CELL_SQL,
        d="SELECT interval_s, v - 1 AS dv FROM c WHERE v <> 1",
        s=SIGNED_SQL.format(by="interval_s"),
        e="SELECT interval_s, (v - vm) / (v + vm) AS e, 1.959963984540054 * sqrt((2 * pow(n, 3) + 3 * pow(n, 2) + n) / 6e0) / ((n * n + n) / 2e0) AS h FROM s",
        then=f"SELECT interval_s, {r('e')} AS effect, {r('tanh(atanh(e) - h)')} AS effect_low, {r('tanh(atanh(e) + h)')} AS effect_high FROM e",
    ),
)
def t10(spark, sf):
    d = hypothesis.signed_rank(cells(spark, sf), ["interval_s"], "v", 1.0)
    return d.select("interval_s", num("effect", "effect"), num("effect_low", "effect_low"), num("effect_high", "effect_high"))


@query(
    "t11_t_to_d",
    with_(
        "peaks",
        c=CELL_SQL,
        s="SELECT interval_s, (avg(v) - 1) / (stddev_samp(v) / sqrt(count(v))) AS t, count(v) - 1e0 AS df FROM c GROUP BY 1",
        then=f"SELECT interval_s, {r('t / sqrt(df)')} AS d FROM s",
    ),
)
def t11(spark, sf):
    d = hypothesis.t_test_1samp(cells(spark, sf), ["interval_s"], "v", 1.0)
    return hypothesis.t_to_d(d, "t", "df").select("interval_s", num("d", "d"))


@query(
    "t12_benjamini_hochberg",
    with_("roi", p="SELECT event_id, region, (mean + 1) / 1000 AS p FROM roi",
          then=f"SELECT event_id, {r('p_adj')} AS p_adj FROM (SELECT event_id, least(1, min(p * m / rk) OVER (PARTITION BY region ORDER BY p DESC, rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj"
               " FROM (SELECT *, count(*) OVER (PARTITION BY region) AS m, row_number() OVER (PARTITION BY region ORDER BY p, event_id) AS rk FROM p))"),
)
def t12(spark, sf):
    d = surrogate(spark, sf, "roi").select("event_id", "region", ((F.col("mean") + 1) / 1000).alias("p"))
    return hypothesis.benjamini_hochberg(d, ["region"]).select("event_id", num("p_adj", "p_adj"))


@query(
    "t22_tidy_test_rows",
    with_(
        "peaks",
        c=CELL_SQL,
        then=f"SELECT interval_s, {r('avg(v)')} AS estimate, {r('(avg(v) - 1) / (stddev_samp(v) / sqrt(count(v)))', 5)} AS statistic, {b('count(v) - 1')} AS parameter FROM c GROUP BY 1",
    ),
)
def t22(spark, sf):
    d = hypothesis.t_test_1samp(cells(spark, sf), ["interval_s"], "v", 1.0)
    d = d.select("interval_s", F.struct(F.col("mean").alias("estimate"), F.col("t").alias("statistic"), F.col("df").alias("parameter")).alias("test"))
    return d.select("interval_s", "test.*").select("interval_s", num("estimate", "estimate"), num("statistic", "statistic", 5), big("parameter", "parameter"))


@query(
    "d1_distribution_functions",
    with_(
        "peaks",
        s="SELECT cell, sum(actual_peak) / count(*) / 10 AS t, count(*) AS n FROM peaks GROUP BY 1",
        then=f"SELECT cell, {r(t_p_sql('t', '(n + 2e0)'), 5)} AS p_t, {r(normal_p_sql('t'), 5)} AS p_z, {r('exp(-t / 2) * (1 + t / 2)')} AS p_chi2,"
        f" {r('pow(1 + t * 2 / (n + 2e0), -(n + 2e0) / 2)')} AS p_f FROM s",
    ),
)
def d1(spark, sf):
    from axonframe.functions import dist

    s = peaks(spark, sf).groupBy("cell").agg((F.sum("actual_peak") / F.count("*") / 10).alias("t"), F.count("*").alias("n"))
    df = (F.col("n") + 2).cast("double")
    return s.select(
        "cell", num(dist.t_p_value("t", df), "p_t", 5), num(dist.normal_p_value("t"), "p_z", 5),
        num(dist.chi2_p_value("t", F.lit(4.0)), "p_chi2"), num(dist.f_p_value("t", F.lit(2.0), df), "p_f"),
    )
