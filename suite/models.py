"""Model fits and the end-to-end analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonframe.operators import models, reshape
from axonframe.plans import ei as ei_plan
from axonframe.plans import enhancement
from suite.base import b, big, num, query, r
from suite.projections import STIM
from suite.stats import SIGNED_SQL, SIGNED_Z, WALSH_SQL, normal_p_sql, t_p_sql
from suite.summaries import t_quantile_sql, top1
from suite.surrogates import EI_ORDINAL, surrogate, with_

ORD = "o1, o2, o3"

# --- E/I balance -----------------------------------------------------------------------------------

CELLS = {
    "a": top1("ei", "filename_plus10", f"filename_minus55, {ORD}", "color = 'blue'"),
    "bb": top1("(SELECT * EXCLUDE (rn) FROM a)", "filename_minus55", f"filename_plus10, {ORD}"),
    "e": "SELECT * EXCLUDE (rn), amp_plus10 / -amp_minus55 AS bal, concat_ws('_', CAST(brain_id AS VARCHAR), CAST(slice_id AS VARCHAR), CAST(cell_id AS VARCHAR)) AS cell_key"
    " FROM bb WHERE amp_plus10 IS NOT NULL AND amp_minus55 IS NOT NULL",
    "large": top1("e", "cell_key", "amp_minus55", "amp_minus55 > -120 AND amp_minus55 < -70 AND rough_ap IS NOT NULL", "rank"),
}


def large_cells(spark, sf):
    raw = surrogate(spark, sf, "ei")
    return ei_plan.large_response_cells(ei_plan.ei_balance(ei_plan.paired_recordings(raw, EI_ORDINAL)))


@query(
    "e1_region_balance",
    with_(
        "ei", **CELLS,
        then=f"SELECT region, {r('avg(bal)')} AS mean, {r('stddev_samp(bal) / sqrt(count(bal))')} AS sem, {b('count(*)')} AS n FROM large GROUP BY 1",
    ),
)
def e1(spark, sf):
    d = ei_plan.region_summary(surrogate(spark, sf, "ei"), EI_ORDINAL)
    return d.select("region", num("mean", "mean"), num("sem", "sem"), big("n_rows", "n"))


@query(
    "e1_small_response_cells",
    with_(
        "ei", **{k: v for k, v in CELLS.items() if k != "large"},
        small=top1("e", "cell_key", f"abs(amp_minus55 + 40), {ORD}, filename_plus10", "amp_minus55 > -50 AND amp_minus55 < -10 AND rough_ap IS NOT NULL"),
        then=f"SELECT cell_key, region, {r('bal')} AS ei_balance, {r('ln(bal)')} AS log_ei_balance FROM small",
    ),
)
def e1_small(spark, sf):
    bal = ei_plan.ei_balance(ei_plan.paired_recordings(surrogate(spark, sf, "ei"), EI_ORDINAL))
    d = ei_plan.small_response_cells(bal, [*EI_ORDINAL, "filename_plus10"])
    return d.select("cell_key", "region", num("ei_balance", "ei_balance"), num("log_ei_balance", "log_ei_balance"))


def positive(spark, sf):
    return surrogate(spark, sf, "ei").withColumn("y", F.col("amp_plus10") / -F.col("amp_minus55"))


YD = "SELECT *, ln(amp_plus10 / -amp_minus55) AS ly, amp_plus10 / -amp_minus55 AS y FROM ei WHERE amp_plus10 IS NOT NULL AND region IS NOT NULL"


@query(
    "t13_two_way_anova",
    with_(
        "ei", d=YD,
        cell="SELECT region, ap_region, count(*) AS n, avg(ly) AS m, sum(ly * ly) AS q FROM d GROUP BY 1, 2",
        g="SELECT sum(n) AS n, sum(n * m) / sum(n) AS gm, sum(q) - sum(n * m * m) AS rss FROM cell",
        ra="SELECT region, sum(n) AS n, sum(n * m) / sum(n) AS m, sum(CASE WHEN ap_region = 'anterior' THEN n END) * sum(CASE WHEN ap_region = 'posterior' THEN n END) / sum(n) AS w,"
        " max(CASE WHEN ap_region = 'anterior' THEN m END) - max(CASE WHEN ap_region = 'posterior' THEN m END) AS df FROM cell GROUP BY 1",
        ss="SELECT (SELECT sum(ra.n * pow(ra.m - g.gm, 2)) FROM ra, g) AS a, (SELECT pow(sum(w * df), 2) / sum(w) FROM ra) AS bb,"
        " (SELECT sum(w * df * df) - pow(sum(w * df), 2) / sum(w) FROM ra) AS ab, g.rss, g.n - 4 AS rdf FROM g",
        t="SELECT 'region' AS term, a AS s, rss, rdf FROM ss UNION ALL SELECT 'ap_region', bb, rss, rdf FROM ss UNION ALL SELECT 'region:ap_region', ab, rss, rdf FROM ss",
        then=f"SELECT term, {b('1')} AS df, {r('s', 5)} AS sumsq, {r('s / (rss / rdf)', 4)} AS f, {r(t_p_sql('sqrt(s / (rss / rdf))', 'rdf'), 4)} AS p FROM t"
        f" UNION ALL SELECT 'Residuals', {b('rdf')}, {r('rss', 5)}, NULL, NULL FROM ss",
    ),
)
def t13(spark, sf):
    d = surrogate(spark, sf, "ei").withColumn("ly", F.log(F.col("amp_plus10") / -F.col("amp_minus55")))
    out = models.two_way_anova(d, "ly", "region", "ap_region")
    return out.select("term", big("df", "df"), num("sumsq", "sumsq", 5), num("f", "f", 4), num("p", "p", 4))


@query(
    "t14_gamma_glm_region",
    with_(
        "ei", d=YD,
        g="SELECT region, count(*) AS n, avg(y) AS m FROM d GROUP BY 1",
        ph="SELECT sum(pow((y - m) / m, 2)) / (count(*) - 2) AS phi, count(*) - 2 AS rdf FROM d JOIN g USING (region)",
        c="SELECT '(Intercept)' AS term, ln(m) AS e, sqrt(phi / n) AS se, rdf FROM g, ph WHERE region = 'ACC'"
        " UNION ALL SELECT 'regionRSC', ln(x.m / z.m), sqrt(phi / x.n + phi / z.n), rdf FROM g x, g z, ph WHERE x.region = 'RSC' AND z.region = 'ACC'",
        then=f"SELECT term, {r('e')} AS estimate, {r('se')} AS std_error, {r('e / se', 3)} AS statistic, {r('CASE WHEN abs(e / se) > 30 THEN 0 ELSE ' + t_p_sql('(e / se)', 'rdf') + ' END', 4)} AS p_value FROM c",
    ),
)
def t14_region(spark, sf):
    fit = models.gamma_glm(positive(spark, sf), "y", {"region": ["ACC", "RSC"]}, [])
    return fit.coefficients.select("term", *[num(c, c) for c in ("estimate", "std_error")], num("statistic", "statistic", 3), num("p_value", "p_value", 4))


# scoring steps on (1, region, position) in a recursion; the information matrix is the same in each
def gamma_sql(rows: str) -> dict[str, str]:
    return {
        "gd": f"SELECT y, CASE WHEN region = 'RSC' THEN 1e0 ELSE 0e0 END AS a, rough_ap::DOUBLE AS x FROM {rows} WHERE y IS NOT NULL AND region IN ('ACC', 'RSC') AND rough_ap IS NOT NULL",
        "im": "SELECT count(*)::DOUBLE AS n, sum(a) AS sa, sum(x) AS sx, sum(a * a) AS aa, sum(a * x) AS ax, sum(x * x) AS xx FROM gd",
        "dt": "SELECT *, n * (aa * xx - ax * ax) - sa * (sa * xx - ax * sx) + sx * (sa * ax - aa * sx) AS det FROM im",
        "iv": "SELECT n, (aa * xx - ax * ax) / det AS i00, (sx * ax - sa * xx) / det AS i01, (sa * ax - sx * aa) / det AS i02, (n * xx - sx * sx) / det AS i11, (sa * sx - n * ax) / det AS i12, (n * aa - sa * sa) / det AS i22 FROM dt",
        "it": "SELECT 0 AS k, (SELECT ln(avg(y)) FROM gd) AS b0, 0e0 AS b1, 0e0 AS b2 UNION ALL SELECT k + 1, b0 + i00 * u.s0 + i01 * u.s1 + i02 * u.s2, b1 + i01 * u.s0 + i11 * u.s1 + i12 * u.s2, b2 + i02 * u.s0 + i12 * u.s1 + i22 * u.s2"
        " FROM it, iv, LATERAL (SELECT sum(y / exp(it.b0 + it.b1 * a + it.b2 * x) - 1) AS s0, sum(a * (y / exp(it.b0 + it.b1 * a + it.b2 * x) - 1)) AS s1, sum(x * (y / exp(it.b0 + it.b1 * a + it.b2 * x) - 1)) AS s2 FROM gd) u WHERE k < 40",
        "be": "SELECT b0, b1, b2 FROM it WHERE k = 40",
        "pe": "SELECT sum(pow(y / exp(b0 + b1 * a + b2 * x) - 1, 2)) / (count(*) - 3) AS phi, count(*) - 3 AS rdf FROM gd, be",
        "co": "SELECT '(Intercept)' AS term, b0 AS e, sqrt(phi * i00) AS se, rdf FROM be, iv, pe UNION ALL SELECT 'regionRSC', b1, sqrt(phi * i11), rdf FROM be, iv, pe UNION ALL SELECT 'rough_ap', b2, sqrt(phi * i22), rdf FROM be, iv, pe",
    }


P_SQL = f"CASE WHEN abs(e / se) > 30 THEN 0 ELSE {t_p_sql('(e / se)', 'rdf')} END"


@query(
    "t14_gamma_glm_region_position",
    with_(
        "ei", d=YD, **gamma_sql("d"),
        then=f"SELECT term, {r('e', 5)} AS estimate, {r('se', 5)} AS std_error, {r('e / se', 4)} AS statistic, {r(P_SQL, 4)} AS p_value FROM co",
    ).replace("WITH", "WITH RECURSIVE", 1),
)
def t14(spark, sf):
    fit = models.gamma_glm(positive(spark, sf), "y", {"region": ["ACC", "RSC"]}, ["rough_ap"])
    return fit.coefficients.select("term", num("estimate", "estimate", 5), num("std_error", "std_error", 5), num("statistic", "statistic", 4), num("p_value", "p_value", 4))


@query(
    "t15_tidy_coefficients",
    with_(
        "ei", **CELLS, d="SELECT *, bal AS y FROM large", **gamma_sql("d"),
        then="SELECT CASE term WHEN 'rough_ap' THEN 'AP coord' ELSE term END AS term, printf('%.3f', e) AS estimate, printf('%.3f', se) AS std_error, printf('%.3f', e / se) AS statistic,"
        f" printf('%.3f', {P_SQL}) AS p_value FROM co",
    ).replace("WITH", "WITH RECURSIVE", 1),
)
def t15(spark, sf):
    from axonframe.functions.scalar import recode

    fit = ei_plan.region_model(large_cells(spark, sf))
    return fit.coefficients.select(
        recode("term", {"rough_ap": "AP coord"}).alias("term"), *[F.format_string("%.3f", c).alias(c) for c in ("estimate", "std_error", "statistic", "p_value")]
    )


@query("t16_mixed_model_crossed")
def t16(spark, sf):
    d = surrogate(spark, sf, "ei").filter("stim_power = 100")
    fit = models.mixed_model(d, "amp_minus55", {"region": ["ACC", "RSC"]}, ["rough_ap", "stim_duration"], "brain_id", "slice_id")
    return fit.anova().select("term", *[num(c, c, 3) for c in ("num_df", "den_df", "f", "p")])


# a subject effect is added so that the between-cell variance is not at its boundary
SUBJECT = (
    "SELECT cell, interval_s, avg(actual_peak) / 20 + (CAST(cell AS BIGINT) % 7) / 5e0 AS v FROM peaks WHERE interval_s > 0 GROUP BY 1, 2"
)
BALANCED = {
    "m": SUBJECT,
    "d": "SELECT cell, interval_s, v FROM m SEMI JOIN (SELECT cell FROM m GROUP BY 1 HAVING count(*) = 4) USING (cell)",
    "mm": "SELECT avg(v) AS g, count(DISTINCT cell) AS n FROM d",
    "lv": "SELECT interval_s, avg(v) AS lm FROM d GROUP BY 1",
    "cm": "SELECT cell, avg(v) AS c FROM d GROUP BY 1",
    "an": "SELECT (SELECT sum(pow(lm - g, 2)) FROM lv, mm) * (SELECT n FROM mm) / 3 AS msl,"
    " (SELECT sum(pow(v - lm - c + g, 2)) FROM d JOIN lv USING (interval_s) JOIN cm USING (cell), mm) / (3 * ((SELECT n FROM mm) - 1)) AS mse, (SELECT n FROM mm) AS n",
}
POSITIVE_INTERVALS = [0.025, 0.05, 0.1, 0.25]


def balanced(spark, sf):
    m = (
        surrogate(spark, sf, "peaks")
        .filter("interval_s > 0")
        .groupBy("cell", "interval_s")
        .agg((F.avg("actual_peak") / 20 + F.col("cell").cast("bigint") % 7 / 5.0).alias("v"))
    )
    return reshape.complete_cases(m, ["cell"], "interval_s", "v", POSITIVE_INTERVALS)


@query(
    "t17_mixed_model_subject",
    with_("peaks", **BALANCED, then=f"SELECT 'interval_s' AS term, {b('3')} AS num_df, {r('3 * (n - 1)', 1)} AS den_df, {r('msl / mse', 4)} AS f FROM an"),
)
def t17(spark, sf):
    fit = models.mixed_model(balanced(spark, sf), "v", {"interval_s": POSITIVE_INTERVALS}, [], "cell")
    return fit.anova().select("term", big("num_df", "num_df"), num("den_df", "den_df", 1), num("f", "f", 4))


@query(
    "t18_marginal_contrasts",
    with_(
        "peaks", **BALANCED,
        p="SELECT x.interval_s AS la, z.interval_s AS lb, x.lm - z.lm AS e, sqrt(2 * mse / n) AS se, 3 * (n - 1) AS df FROM lv x JOIN lv z ON x.interval_s < z.interval_s, an",
        then=f"SELECT CAST(la AS VARCHAR) AS level_a, CAST(lb AS VARCHAR) AS level_b, {r('e', 5)} AS estimate, {r('se', 5)} AS std_error, {r('e / se', 4)} AS t, {r(t_p_sql('(e / se)', 'df'), 4)} AS p FROM p",
    ),
)
def t18(spark, sf):
    fit = models.mixed_model(balanced(spark, sf), "v", {"interval_s": POSITIVE_INTERVALS}, [], "cell")
    d = fit.contrasts("interval_s", POSITIVE_INTERVALS)
    return d.select("level_a", "level_b", num("estimate", "estimate", 5), num("std_error", "std_error", 5), num("t", "t", 4), num("p", "p", 4))


# intervals count as a random factor too; an effect is added so that its variance is not at its boundary
CROSSED = {
    **BALANCED,
    "dx": "SELECT cell, interval_s, v + interval_s * 8 AS v FROM d",
    "nn": "SELECT avg(v) AS g, count(DISTINCT cell) AS n FROM dx",
    "xl": "SELECT interval_s, avg(v) AS lm FROM dx GROUP BY 1",
    "xc": "SELECT cell, avg(v) AS cm FROM dx GROUP BY 1",
    "ms": "SELECT n, g, (SELECT sum(pow(lm - g, 2)) FROM xl) * n / 3 AS msl, (SELECT sum(pow(cm - g, 2)) FROM xc) * 4 / (n - 1) AS msc,"
    " (SELECT sum(pow(v - lm - cm + g, 2)) FROM dx JOIN xl USING (interval_s) JOIN xc USING (cell)) / (3 * (n - 1)) AS mse FROM nn",
}


@query(
    "t16_crossed_variance_balanced",
    with_(
        "peaks", **CROSSED,
        then=f"SELECT 'cell' AS \"group\", {r('sqrt((msc - mse) / 4)', 4)} AS sd FROM ms UNION ALL SELECT 'interval_s', {r('sqrt((msl - mse) / n)', 4)} FROM ms"
        f" UNION ALL SELECT 'Residual', {r('sqrt(mse)', 4)} FROM ms",
    ),
)
def t16_balanced(spark, sf):
    d = balanced(spark, sf).withColumn("v", F.col("v") + F.col("interval_s") * 8)
    fit = models.mixed_model(d, "v", {}, [], "cell", "interval_s")
    return fit.variance_components().select("group", num("sd", "sd", 4))


def keyed_cells(spark, sf):
    return large_cells(spark, sf).withColumn("key", F.concat_ws("-", "filename_plus10", "filename_minus55", *EI_ORDINAL)).filter("region IS NOT NULL")


@query("t19_residual_diagnostics")
def t19(spark, sf):
    data = keyed_cells(spark, sf)
    fit = ei_plan.region_model(data)
    used, _ = models.with_terms(data, {"region": ["ACC", "RSC"]}, ["rough_ap"])
    sim = models.simulate(used, "ei_balance", F.exp(fit.linear_predictor()), fit.dispersion, "key")
    res = models.residuals_of(sim).withColumn("all", F.lit("all"))
    ks = models.uniformity_test(res, ["all"]).select(F.lit("uniformity").alias("test"), num("d", "statistic"), num("p", "p"))
    disp = models.dispersion_of(sim).select(F.lit("dispersion").alias("test"), num("dispersion_ratio", "statistic"), num("p", "p"))
    return ks.unionByName(disp)


# A residual is a share of n draws: it lies within six standard errors of the gamma distribution function, and the
# dispersion ratio within a few percent of its closed form.
@query(
    "t19_region_residuals",
    with_(
        "ei", **CELLS,
        d="SELECT *, avg(bal) OVER (PARTITION BY region) AS m FROM large WHERE region IS NOT NULL AND bal IS NOT NULL",
        ph="SELECT sum(pow((bal - m) / m, 2)) / (count(*) - 2) AS phi FROM d",
        then=f"SELECT {b('count(*)')} AS n, {r('max(phi)', 5)} AS dispersion, {r('sqrt(sum(pow(bal - m, 2)) / (max(phi) * sum(m * m)))', 5)} AS expected_ratio, TRUE AS ratio_fits, {b('0')} AS n_off FROM d, ph",
    ),
)
def t19_region(spark, sf):
    from axonframe.functions import dist

    data = keyed_cells(spark, sf)
    fit = models.gamma_glm(data, "ei_balance", {"region": ["ACC", "RSC"]}, [])
    used, _ = models.with_terms(data, {"region": ["ACC", "RSC"]}, [])
    sim = models.simulate(used, "ei_balance", F.exp(fit.linear_predictor()), fit.dispersion, "key", n_sim=1000)
    below = 1 - dist.chi2_p_value(2 * F.col("observed") / (F.col("fitted") * fit.dispersion), F.lit(2 / fit.dispersion))
    res = models.residuals_of(sim).withColumn("p", below)
    off = F.abs(F.col("residual") - F.col("p")) > 6 * F.sqrt((F.col("p") * (1 - F.col("p")) + 1e-3) / 1000) + 2e-3
    ratio = F.sqrt(F.sum((F.col("observed") - F.col("fitted")) ** 2) / (fit.dispersion * F.sum(F.col("fitted") ** 2)))
    total = res.agg(F.count(F.lit(1)).alias("n"), ratio.alias("expected"), F.count_if(off).alias("off"))
    d = total.crossJoin(models.dispersion_of(sim))  # one row each
    return d.select(
        big("n", "n"), num(F.lit(fit.dispersion), "dispersion", 5), num("expected", "expected_ratio", 5),
        (F.abs(F.col("dispersion_ratio") / F.col("expected") - 1) < 0.05).alias("ratio_fits"), big("off", "n_off"),
    )


@query(
    "t23_grouped_apply",
    with_(
        "roi",
        c="SELECT region, mouse_id, avg(mean) AS v, count(*) AS k FROM roi GROUP BY 1, 2",
        then=f"SELECT region, {r('corr(v, k)')} AS r, {b('count(*)')} AS n FROM c GROUP BY 1",
    ),
)
def t23(spark, sf):
    """A user's function (a correlation from running sums) over the batches of each region."""
    import numpy as np

    from axonframe.operators.grouped import grouped_apply

    c = surrogate(spark, sf, "roi").groupBy("region", "mouse_id").agg(F.avg("mean").alias("v"), F.count("*").cast("double").alias("k")).drop("mouse_id")

    def step(state, batch):
        v, k = batch.column("v").to_numpy(), batch.column("k").to_numpy()
        return state + np.array([len(v), v.sum(), k.sum(), (v * v).sum(), (v * k).sum(), (k * k).sum()])

    def finish(state):
        n, v, k, vv, vk, kk = state
        return {"r": float((n * vk - v * k) / np.sqrt((n * vv - v * v) * (n * kk - k * k))), "n": int(n)}

    d = grouped_apply(c.filter("v IS NOT NULL"), ["region"], lambda: np.zeros(6), step, finish, "r double, n bigint", merge=lambda a, b: a + b)
    return d.select("region", num("r", "r"), big("n", "n"))


# --- enhancement index -----------------------------------------------------------------------------

PARSED = (
    "SELECT cell AS cell_id, interval_s AS interval, regexp_matches(log, '(?i)PTX') AS ptx, regexp_matches(log, '(?i)4\\s*-?\\s*AP') AS ap4,"
    f" regexp_extract_all(log, '{STIM}')[1] AS stim1, regexp_extract_all(log, '{STIM}')[2] AS stim2,"
    " TRY_CAST(nullif(regexp_extract(log, '(?i)PTX\\s+([0-9.]+)\\s*(uM|mM)', 1), '') AS DOUBLE) AS ptx_conc,"
    " TRY_CAST(nullif(regexp_extract(log, '(?i)4\\s*-?\\s*AP\\s+([0-9.]+)\\s*(uM|mM)', 1), '') AS DOUBLE) AS ap4_conc,"
    " contains(log, '-75 mV') AS hold75, CASE WHEN contains(log, '-75 mV') THEN '-75 mV' ELSE '-55 mV' END AS vhold, intra, actual_peak, estimated_peak, first_peak, third_peak FROM peaks WHERE interval_s > 0"
)
FILTERS = {
    "normal": "hold75 AND NOT ptx AND NOT ap4",
    "ptx": "hold75",
    "4ap": "hold75",
    "cs_vs_k": "regexp_matches(stim1, '^R_1')",
    "vhold": "regexp_matches(stim1, '^R_1')",
    "vhold_and_cs_vs_k": "regexp_matches(stim1, '^R_1') AND NOT ptx AND NOT ap4",
}


def sweeps(spark, sf):
    hold = F.when(F.col("log").contains("-75 mV"), "-75 mV").otherwise("-55 mV")
    return surrogate(spark, sf, "peaks").select(
        F.col("cell").alias("cell_id"), F.col("interval_s").alias("interval"), "log", "actual_peak", "estimated_peak", "first_peak", "third_peak", hold.alias("vhold"), "intra"
    )


def _register_variant(name: str, where: str) -> None:
    keys = enhancement.VARIANTS[name].keys
    key_sql, means = ", ".join(keys), enhancement.VARIANTS[name].means
    sql = with_(
        "peaks", p=PARSED,
        then=f"SELECT {key_sql}, {', '.join(f'{r(f"avg({m})")} AS {m}' for m in means)}, {r('avg(actual_peak) / avg(estimated_peak)')} AS enhancement_index"
        f" FROM p WHERE stim1 IS NOT NULL AND stim2 IS NOT NULL AND {where} GROUP BY {key_sql}",
    )

    @query(f"e2_enhancement_{name}", sql)
    def run(spark, sf):
        d = enhancement.enhancement_index(sweeps(spark, sf), name)
        return d.select(*keys, *[num(c, c) for c in (*means, "enhancement_index")])


for _name, _where in FILTERS.items():
    _register_variant(_name, _where)


@query("e2_interval_summary")
def e2_summary(spark, sf):
    d = enhancement.interval_summary(enhancement.enhancement_index(sweeps(spark, sf), "normal"))
    return d.select("interval", big("n_valid", "n"), *[num(c, c) for c in ("mean", "ci_low", "ci_high", "p", "effect", "effect_low", "effect_high")])


@query("e2_across_intervals")
def e2_across(spark, sf):
    _, pairs = enhancement.across_intervals(enhancement.enhancement_index(sweeps(spark, sf), "normal"), [0.025, 0.05, 0.1, 0.25])
    return pairs.select("level_a", "level_b", *[num(c, c, 5) for c in ("estimate", "p", "p_adj", "d", "d_low", "d_high")])




# --- comparisons of conditions and drugs -----------------------------------------------------------

MEASURES = ["actual_peak", "estimated_peak", "first_peak", "third_peak", "enhancement_index"]


def _cells_sql(name: str) -> str:
    v = enhancement.VARIANTS[name]
    return f"SELECT {', '.join(v.keys)}, {', '.join(f'avg({m}) AS {m}' for m in v.means)}, avg(actual_peak) / avg(estimated_peak) AS enhancement_index FROM p WHERE stim1 IS NOT NULL AND stim2 IS NOT NULL AND {FILTERS[name]} GROUP BY {', '.join(v.keys)}"


def _conditions_sql(label: str) -> str:
    stacked = " UNION ALL ".join(f"SELECT '{m}' AS measure, interval, {label} AS condition, {m} AS v FROM cl" for m in MEASURES)
    return (
        f"SELECT measure, interval, condition, {r('avg(v)', 5)} AS mean, {r('stddev_samp(v) / sqrt(count(v))', 5)} AS sem, {b('count(*)')} AS n_rows, {b('count(v)')} AS n_valid,"
        f" {r('stddev_samp(v) / sqrt(count(v)) * ' + t_quantile_sql('(count(v) - 1e0)'), 4)} AS ci FROM ({stacked}) GROUP BY 1, 2, 3 HAVING count(v) > 1"
    )


def _condition_rows(d):
    return d.filter("n_valid > 1").select("measure", "interval", "condition", num("mean", "mean", 5), num("sem", "sem", 5), big("n_rows", "n_rows"), big("n_valid", "n_valid"), num("ci", "ci", 4))


@query("e3_cs_vs_k_tables", with_("peaks", p=PARSED, cl=_cells_sql("cs_vs_k"), then=_conditions_sql("intra")))
def e3_intra(spark, sf):
    return _condition_rows(enhancement.condition_tables(enhancement.enhancement_index(sweeps(spark, sf), "cs_vs_k"), "intra", MEASURES))


@query("e3_holding_tables", with_("peaks", p=PARSED, cl=_cells_sql("vhold"), then=_conditions_sql("CASE vhold WHEN '-75 mV' THEN 'rest' ELSE 'depolarised' END")))
def e3_hold(spark, sf):
    cells = enhancement.enhancement_index(sweeps(spark, sf), "vhold")
    return _condition_rows(enhancement.condition_tables(cells, "vhold", MEASURES, {"-75 mV": "rest", "-55 mV": "depolarised"}))


JOINED = enhancement.Variant(None, ("ptx", "ap4"), "^R_1", ("cell_id", "interval", "stim1", "stim2", "vhold", "intra"), tuple(MEASURES[:4]))


@query(
    "e3_joined_condition_tables",
    with_(
        "peaks", p=PARSED,
        cl=f"SELECT {', '.join(JOINED.keys)}, {', '.join(f'avg({m}) AS {m}' for m in JOINED.means)}, avg(actual_peak) / avg(estimated_peak) AS enhancement_index FROM p WHERE stim1 IS NOT NULL AND stim2 IS NOT NULL AND {FILTERS['vhold_and_cs_vs_k']} GROUP BY {', '.join(JOINED.keys)}",
        then=_conditions_sql("vhold || ' ' || intra"),
    ),
)
def e3_joined(spark, sf):
    cells = enhancement.joined_conditions(enhancement.enhancement_index(sweeps(spark, sf), JOINED), "vhold", "intra")
    return _condition_rows(enhancement.condition_tables(cells, "condition", MEASURES))


@query(
    "e3_ptx_paired_t",
    with_(
        "peaks", p=PARSED, cl=_cells_sql("ptx"),
        pr="SELECT a.interval, a.enhancement_index AS x, d.enhancement_index AS y FROM (SELECT * FROM cl WHERE NOT ptx) a JOIN (SELECT * FROM cl WHERE ptx AND ptx_conc BETWEEN 20 AND 30) d USING (cell_id, interval, stim1, stim2) WHERE a.enhancement_index IS NOT NULL AND d.enhancement_index IS NOT NULL",
        s="SELECT interval, count(*) AS n, avg(x) AS ma, avg(y) AS mb, avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))) AS t FROM pr GROUP BY 1",
        then=f"SELECT interval, {b('n')} AS n_pairs, {r('ma', 5)} AS mean_acsf, {r('mb', 5)} AS mean_drug, {r('t', 5)} AS statistic, {r(t_p_sql('t', '(n - 1e0)'), 5)} AS p FROM s WHERE n > 1",
    ),
)
def e3_ptx(spark, sf):
    pairs = enhancement.drug_pairs(enhancement.enhancement_index(sweeps(spark, sf), "ptx"), "ptx", 20, 30)
    d = enhancement.paired_t(pairs).filter("n_pairs > 1")
    return d.select("interval", big("n_pairs", "n_pairs"), num("mean_a", "mean_acsf", 5), num("mean_b", "mean_drug", 5), num("t", "statistic", 5), num("p", "p", 5))


@query(
    "e3_ptx_paired_long",
    with_(
        "peaks", p=PARSED, cl=_cells_sql("ptx"),
        pr="SELECT cell_id, interval, stim1, stim2, a.enhancement_index AS x, d.enhancement_index AS y FROM (SELECT * FROM cl WHERE NOT ptx) a JOIN (SELECT * FROM cl WHERE ptx AND ptx_conc BETWEEN 20 AND 30) d USING (cell_id, interval, stim1, stim2) WHERE a.enhancement_index IS NOT NULL AND d.enhancement_index IS NOT NULL",
        then=f"SELECT cell_id, interval, 'ACSF' AS cond, {r('x', 5)} AS enh FROM pr UNION ALL SELECT cell_id, interval, 'PTX' AS cond, {r('y', 5)} AS enh FROM pr",
    ),
)
def e3_ptx_long(spark, sf):
    pairs = enhancement.drug_pairs(enhancement.enhancement_index(sweeps(spark, sf), "ptx"), "ptx", 20, 30)
    long = enhancement.paired_long(pairs, {"enhancement_index_acsf": "ACSF", "enhancement_index_drug": "PTX"})
    return long.select("cell_id", "interval", "cond", num("enh", "enh", 5))


@query(
    "e3_interval_summary_nonparametric",
    with_(
        "peaks", p=PARSED, cl=_cells_sql("normal"),
        c="SELECT cell_id AS cell, interval AS interval_s, enhancement_index AS v FROM cl",
        **WALSH_SQL,
        d="SELECT interval_s, v - 1 AS dv FROM c WHERE v <> 1",
        s=SIGNED_SQL.format(by="interval_s"),
        z=f"SELECT *, {SIGNED_Z} AS z FROM s",
        lim="SELECT interval_s, l[CAST(round_even(least(greatest(mean - half, 0), p - 1), 0) AS BIGINT) + 1] AS lo, l[CAST(round_even(least(greatest(mean + half - 1, 0), p - 1), 0) AS BIGINT) + 1] AS hi FROM q",
        m="SELECT interval_s, avg(v) AS mean, count(v) AS n FROM c GROUP BY 1",
        then=f"SELECT interval_s AS interval, {b('m.n')} AS n_valid, {r('mean')} AS mean, {r('lo', 4)} AS ci_low, {r('hi', 4)} AS ci_high, {r(normal_p_sql('z'), 5)} AS p FROM m JOIN lim USING (interval_s) JOIN z USING (interval_s)",
    ),
)
def e3_nonparametric(spark, sf):
    d = enhancement.interval_summary(enhancement.enhancement_index(sweeps(spark, sf), "normal"), nonparametric=True)
    return d.select("interval", big("n_valid", "n_valid"), num("mean", "mean"), num("ci_low", "ci_low", 4), num("ci_high", "ci_high", 4), num("p", "p", 5))
