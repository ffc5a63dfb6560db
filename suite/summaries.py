"""Joins, aggregations, windows and row picks on the tabular surrogates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from axonframe.functions import scalar
from axonframe.operators import pair, pick, reshape, summarise
from suite.base import b, big, num, query, r, table
from suite.surrogates import EI_ORDINAL, INTERVALS, pixels, strips, surrogate, with_

KEY = ["filename_plus10", "filename_minus55", "o1", "o2", "o3"]
KEY_OUT = ["filename_plus10", "filename_minus55", "o1", "o2", "o3"]
KEY_SQL = "filename_plus10, filename_minus55, o1, o2, o3"
ORD = "o1, o2, o3"


def ei(spark, sf):
    return surrogate(spark, sf, "ei")


def peaks(spark, sf):
    return surrogate(spark, sf, "peaks")


def top1(source: str, keys: str, order: str, where: str = "true", rank: str = "row_number") -> str:
    return f"SELECT * FROM (SELECT *, {rank}() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source} WHERE {where}) WHERE rn = 1"


# --- row picks -------------------------------------------------------------------------------------


@query("w3_slice_min", with_("ei", d=top1("ei", "filename_plus10", f"filename_minus55, {ORD}"), then=f"SELECT {KEY_SQL} FROM d"))
def w3(spark, sf):
    return pick.slice_min(ei(spark, sf), ["filename_plus10"], "filename_minus55", EI_ORDINAL).select(*KEY_OUT)


DEDUP = {
    "a": top1("ei", "filename_plus10", f"filename_minus55, {ORD}", "color = 'blue'"),
    "bb": top1("(SELECT * EXCLUDE (rn) FROM a)", "filename_minus55", f"filename_plus10, {ORD}"),
}


@query("w4_pair_dedup", with_("ei", **DEDUP, then=f"SELECT {KEY_SQL} FROM bb"))
def w4(spark, sf):
    d = ei(spark, sf).filter("color = 'blue'")
    return pick.pair_dedup(d, "filename_plus10", "filename_minus55", EI_ORDINAL).select(*KEY_OUT)


CELL = "brain_id, slice_id, cell_id"
CELLS = ["brain_id", "slice_id", "cell_id"]


@query(
    "w5_slice_min_ties",
    with_("ei", d=top1("ei", CELL, "amp_minus55", "amp_minus55 < -70 AND amp_minus55 > -120", "rank"), then=f"SELECT {KEY_SQL}, {r('amp_minus55')} AS amp FROM d"),
)
def w5(spark, sf):
    d = ei(spark, sf).filter("amp_minus55 < -70 AND amp_minus55 > -120")
    return pick.slice_min(d, CELLS, "amp_minus55").select(*KEY_OUT, num("amp_minus55", "amp"))


@query(
    "w6_nearest_to_target",
    with_("ei", d=top1("ei", CELL, f"abs(amp_minus55 + 40), {ORD}, filename_plus10", "amp_minus55 < -10 AND amp_minus55 > -50"), then=f"SELECT {KEY_SQL} FROM d"),
)
def w6(spark, sf):
    d = ei(spark, sf).filter("amp_minus55 < -10 AND amp_minus55 > -50")
    return pick.nearest(d, CELLS, "amp_minus55", -40, [*EI_ORDINAL, "filename_plus10"]).select(*KEY_OUT)


@query(
    "w7_nearest_to_median",
    with_(
        "ei",
        s="SELECT *, quantile_cont(amp_plus10, 0.5) OVER (PARTITION BY brain_id, region) AS med FROM ei WHERE stim_power = 100",
        d=top1("(SELECT *, abs(amp_plus10 - med) AS dist FROM s)", "brain_id, region", "dist NULLS LAST", rank="rank"),
        then=f"SELECT {KEY_SQL}, {r('dist')} AS dist FROM d",
    ),
)
def w7(spark, sf):
    d = ei(spark, sf).filter("stim_power = 100")
    return pick.nearest_to_median(d, ["brain_id", "region"], "amp_plus10").select(*KEY_OUT, num("dist_to_median", "dist"))


@query(
    "w8_slice_max",
    with_("ei", d=top1("ei", "brain_id", f"amp_plus10 DESC NULLS LAST, {ORD}, filename_plus10"), then=f"SELECT brain_id, {r('amp_plus10')} AS amp FROM d"),
)
def w8(spark, sf):
    d = pick.slice_max(ei(spark, sf), ["brain_id"], "amp_plus10", [*EI_ORDINAL, "filename_plus10"])
    return d.select("brain_id", num("amp_plus10", "amp"))


@query("o1_top_per_group", with_("peaks", d=top1("peaks", "cell", "actual_peak DESC, event_id"), then=f"SELECT cell, event_id, {r('actual_peak')} AS peak FROM d"))
def o1(spark, sf):
    return pick.slice_max(peaks(spark, sf), ["cell"], "actual_peak", ["event_id"]).select("cell", "event_id", num("actual_peak", "peak"))


@query(
    "w1_min_max_scale",
    with_(
        "roi",
        then="SELECT event_id, " + r("(mean - min(mean) OVER w) / nullif(max(mean) OVER w - min(mean) OVER w, 0)") + " AS scaled FROM roi WINDOW w AS (PARTITION BY region, mouse_id)",
    ),
)
def w1(spark, sf):
    return summarise.min_max_scale(surrogate(spark, sf, "roi"), ["region", "mouse_id"], "mean", "scaled").select("event_id", num("scaled", "scaled"))


@query(
    "w2_z_score",
    with_("ei", then=f"SELECT {KEY_SQL}, " + r("(amp_plus10 - avg(amp_plus10) OVER w) / nullif(stddev_samp(amp_plus10) OVER w, 0)", 5) + " AS z FROM ei WINDOW w AS (PARTITION BY brain_id)"),
)
def w2(spark, sf):
    return summarise.z_score(ei(spark, sf), ["brain_id"], "amp_plus10", "z").select(*KEY_OUT, num("z", "z", 5))


# --- joins -----------------------------------------------------------------------------------------


@query(
    "j1_self_pair_left",
    with_(
        "roi",
        m="SELECT mouse_id, region, axis, avg(mean) AS mean FROM roi GROUP BY ALL",
        then=f"SELECT a.mouse_id, a.region, {r('a.mean')} AS mean_patch, {r('c.mean')} AS mean_interpatch, {r('a.mean / nullif(c.mean, 0)')} AS ratio"
        " FROM (SELECT * FROM m WHERE axis = 'altitude') a LEFT JOIN (SELECT * FROM m WHERE axis = 'azimuth') c USING (mouse_id, region)",
    ),
)
def j1(spark, sf):
    m = surrogate(spark, sf, "roi").groupBy("mouse_id", "region", "axis").agg(F.avg("mean").alias("mean"))
    d = pair.pair_unique(m, F.col("axis") == "altitude", F.col("axis") == "azimuth", ["mouse_id", "region"], ["mean"], ("_patch", "_interpatch"))
    return d.select("mouse_id", "region", num("mean_patch", "mean_patch"), num("mean_interpatch", "mean_interpatch"), num(scalar.ratio("mean_patch", "mean_interpatch"), "ratio"))


@query(
    "j2_dimension_join",
    with_(
        "roi",
        dim="SELECT DISTINCT axis, roi_id AS unique_roiid, roi_id * 5e0 - 40 AS degree FROM roi WHERE roi_id <> 7",
        then=f"SELECT event_id, {r('degree')} AS degree FROM roi LEFT JOIN dim ON roi.axis = dim.axis AND roi.roi_id = dim.unique_roiid",
    ),
)
def j2(spark, sf):
    d = surrogate(spark, sf, "roi")
    dim = d.filter("roi_id <> 7").select("axis", F.col("roi_id").alias("unique_roiid"), (F.col("roi_id") * 5.0 - 40).alias("degree")).distinct()
    return pair.dimension_join(d, dim, ["axis", "roi_id"], ["axis", "unique_roiid"]).select("event_id", num("degree", "degree"))


MODES = (
    "SELECT opsin, region, brain_id, stim_duration AS mode_duration FROM (SELECT *, row_number() OVER (PARTITION BY opsin, region, brain_id"
    " ORDER BY n DESC, stim_duration) AS rn FROM (SELECT opsin, region, brain_id, stim_duration, count(*) AS n FROM ei GROUP BY ALL)) WHERE rn = 1"
)


@query(
    "j3_many_to_many_filter",
    with_(
        "ei",
        mode_table=MODES,
        then=f"SELECT e.brain_id, {b('count(*)')} AS n, {r('sum(e.amp_minus55)', 3)} AS total FROM ei e JOIN mode_table m ON e.brain_id = m.brain_id"
        " WHERE e.stim_power = 100 AND e.stim_duration = m.mode_duration GROUP BY 1",
    ),
)
def j3(spark, sf):
    d = ei(spark, sf)
    modes = pick.group_mode(d, ["opsin", "region", "brain_id"], "stim_duration", "mode_duration").select("brain_id", "mode_duration")
    joined = d.filter("stim_power = 100").join(modes, "brain_id", "left").filter("stim_duration = mode_duration")
    return joined.groupBy("brain_id").agg(big(F.count("*"), "n"), num(F.sum("amp_minus55"), "total", 3))


COND_SQL = (
    "SELECT cell, interval_s, regexp_extract(log, '^(R_\\d)', 1) AS stim1, regexp_matches(log, '(?i)ptx') AS ptx,"
    " avg(actual_peak) / nullif(avg(estimated_peak), 0) AS ei FROM peaks WHERE interval_s > 0 GROUP BY ALL"
)


def cell_conditions(spark, sf):
    return (
        peaks(spark, sf)
        .filter("interval_s > 0")
        .groupBy("cell", "interval_s", F.regexp_extract("log", r"^(R_\d)", 1).alias("stim1"), F.col("log").rlike("(?i)ptx").alias("ptx"))
        .agg(scalar.ratio(F.avg("actual_peak"), F.avg("estimated_peak")).alias("ei"))
    )


@query(
    "j4_control_drug_pairs",
    with_(
        "peaks",
        c=COND_SQL,
        then=f"SELECT a.cell, a.interval_s, a.stim1, {r('a.ei')} AS ei_acsf, {r('d.ei')} AS ei_ptx FROM (SELECT * FROM c WHERE NOT ptx) a"
        " JOIN (SELECT * FROM c WHERE ptx) d ON a.cell = d.cell AND a.interval_s = d.interval_s AND a.stim1 IS NOT DISTINCT FROM d.stim1",
    ),
)
def j4(spark, sf):
    d = pair.pair_join(cell_conditions(spark, sf), ~F.col("ptx"), F.col("ptx"), ["cell", "interval_s", "stim1"], ["ei"], ("_acsf", "_ptx"))
    return d.dropna(subset=["ei_acsf", "ei_ptx"]).select("cell", "interval_s", "stim1", num("ei_acsf", "ei_acsf"), num("ei_ptx", "ei_ptx"))


@query(
    "j7_pixels_in_tiles",
    with_(
        "px",
        t="SELECT ty, tx FROM range(0, 49, 16) a(ty), range(0, 49, 16) c(tx)",
        then=f"SELECT image_id, {b('ty')} AS ty, {b('tx')} AS tx, {r('sum(v)', 3)} AS total, {b('count_if(m)')} AS inside FROM px JOIN t"
        " ON y >= ty AND y < ty + 16 AND x >= tx AND x < tx + 16 GROUP BY 1, 2, 3",
    ),
)
def j7(spark, sf):
    from axonframe.operators import raster

    return raster.tile_sums(pixels(spark, sf), roi=16, stride=16).select("image_id", "ty", "tx", num("total", "total", 3), big("inside", "inside"))


@query("j9_mask_select", with_("px", then=f"SELECT image_id, y, x, {r('v')} AS v FROM px WHERE m"))
def j9(spark, sf):
    from axonframe.sources import rasters

    d = strips(spark, sf)
    masks = d.select("image_id", "y", "mask")
    return rasters.mask_select(d.select("image_id", "y", "pixels"), masks).select("image_id", "y", "x", num("v", "v"))


@query(
    "j10_level_pairs",
    with_(
        "peaks",
        m="SELECT cell, interval_s, avg(actual_peak) AS v FROM peaks GROUP BY 1, 2",
        then=f"SELECT a.cell, a.interval_s AS level_a, c.interval_s AS level_b, {r('a.v')} AS value_a, {r('c.v')} AS value_b FROM m a JOIN m c"
        " ON a.cell = c.cell AND a.interval_s < c.interval_s",
    ),
)
def j10(spark, sf):
    d = pair.level_pairs(peaks(spark, sf), ["cell"], "interval_s", "actual_peak", INTERVALS)
    return d.select("cell", "level_a", "level_b", num("value_a", "value_a"), num("value_b", "value_b"))


# --- aggregations ----------------------------------------------------------------------------------


@query(
    "a1_grouped_mean_null_keys",
    with_("ei", then=f"SELECT opsin, region, color, {r('avg(amp_plus10)')} AS amp_plus10, {r('avg(rough_ap)')} AS rough_ap FROM ei GROUP BY 1, 2, 3"),
)
def a1(spark, sf):
    d = summarise.group_means(ei(spark, sf), ["opsin", "region", "color"], ["amp_plus10", "rough_ap"])
    return d.select("opsin", "region", "color", num("amp_plus10", "amp_plus10"), num("rough_ap", "rough_ap"))


@query(
    "a2_multi_column_mean",
    with_("ei", then="SELECT brain_id, slice_id, " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in ("amp_minus55", "amp_plus10", "rough_ap", "stim_power")) + " FROM ei GROUP BY 1, 2"),
)
def a2(spark, sf):
    cols = ["amp_minus55", "amp_plus10", "rough_ap", "stim_power"]
    return summarise.group_means(ei(spark, sf), ["brain_id", "slice_id"], cols).select("brain_id", "slice_id", *[num(c, c) for c in cols])


MEAN_SQL = (
    "{k}, " + r("avg({v})") + " AS mean, " + r("stddev_samp({v}) / sqrt(count({v}))") + f" AS sem, {b('count(*)')} AS n_rows, {b('count({v})')} AS n_valid"
)


@query("a3_mean_sem_n", with_("ei", then="SELECT " + MEAN_SQL.format(k="region, ap_region", v="amp_plus10") + " FROM ei GROUP BY 1, 2"))
def a3(spark, sf):
    d = summarise.mean_table(ei(spark, sf), ["region", "ap_region"], "amp_plus10")
    return d.select("region", "ap_region", num("mean", "mean"), num("sem", "sem"), big("n_rows", "n_rows"), big("n_valid", "n_valid"))


# Quantile of t at 0.975: for few degrees of freedom from the closed form of its distribution, beyond that
# from the normal one by its series in 1/df (both independent of the library's bisection of the incomplete beta).
Z = 1.959963984540054
SERIES = [
    (Z**3 + Z) / 4,
    (5 * Z**5 + 16 * Z**3 + 3 * Z) / 96,
    (3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384,
    (79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160,
]
CLOSED = 60  # the series is off by less than 1e-9 from here on


def _central_mass(t: float, df: int) -> float:
    """P(|T| < t) for whole df: a finite sum of powers of the cosine of atan(t / sqrt(df))."""
    angle = math.atan(t / math.sqrt(df))
    c, total = math.cos(angle), 0.0
    term = c if df % 2 else 1.0
    for k in range(1 + df % 2, df, 2):
        total += term
        term *= c * c * k / (k + 1)
    return 2 / math.pi * (angle + math.sin(angle) * total) if df % 2 else math.sin(angle) * total


def _quantile(df: int) -> float:
    low, high = 0.0, 20.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _central_mass(mid, df) < 0.95 else (low, mid)
    return low


def t_quantile_sql(df: str) -> str:
    series = " + ".join([f"{Z}", *[f"{c!r} / pow({df}, {i})" for i, c in enumerate(SERIES, 1)]])
    few = ", ".join(f"{_quantile(k)!r}::DOUBLE" for k in range(1, CLOSED + 1))
    return f"(CASE WHEN {df} <= {CLOSED} THEN list_value({few})[greatest(CAST({df} AS BIGINT), 1)] ELSE {series} END)"


CI_SQL = r(f"{t_quantile_sql('(count(v) - 1e0)')} * stddev_samp(v) / sqrt(count(v))", 4)


@query(
    "a4_mean_t_interval",
    with_(
        "peaks",
        c="SELECT cell, interval_s, avg(actual_peak) AS v FROM peaks GROUP BY 1, 2",
        then=f"SELECT interval_s, {r('avg(v)')} AS mean, {CI_SQL} AS ci, {b('count(v)')} AS n FROM c GROUP BY 1",
    ),
)
def a4(spark, sf):
    c = peaks(spark, sf).groupBy("cell", "interval_s").agg(F.avg("actual_peak").alias("v"))
    d = summarise.mean_table(c, ["interval_s"], "v", ci=True)
    return d.select("interval_s", num("mean", "mean"), num("ci", "ci", 4), big("n_valid", "n"))


@query(
    "a5_mean_cl_normal",
    with_(
        "roi",
        c="SELECT region, mouse_id, avg(mean) AS v FROM roi GROUP BY 1, 2",
        t=f"SELECT region, avg(v) AS m, {t_quantile_sql('(count(v) - 1e0)')} * stddev_samp(v) / sqrt(count(v)) AS h FROM c GROUP BY 1",
        then=f"SELECT region, {r('m', 4)} AS mean, {r('m - h', 4)} AS low, {r('m + h', 4)} AS high FROM t",
    ),
)
def a5(spark, sf):
    c = surrogate(spark, sf, "roi").groupBy("region", "mouse_id").agg(F.avg("mean").alias("v"))
    d = summarise.mean_table(c, ["region"], "v", ci=True)
    return d.select("region", num("mean", "mean", 4), num(F.col("mean") - F.col("ci"), "low", 4), num(F.col("mean") + F.col("ci"), "high", 4))


@query(
    "a6_spread",
    with_("ei", then=f"SELECT region, color, {r('min(amp_plus10)')} AS min, {r('max(amp_plus10)')} AS max, {r('stddev_samp(amp_plus10)')} AS sd, {r('quantile_cont(amp_plus10, 0.5)')} AS median, {b('count(amp_plus10)')} AS n FROM ei GROUP BY 1, 2"),
)
def a6(spark, sf):
    d = summarise.spread_table(ei(spark, sf), ["region", "color"], "amp_plus10")
    return d.select("region", "color", *[num(c, c) for c in ("min", "max", "sd", "median")], big("n", "n"))


@query("a7_group_mode", with_("ei", mode_table=MODES, then=f"SELECT opsin, region, brain_id, {b('mode_duration')} AS mode_duration FROM mode_table"))
def a7(spark, sf):
    d = pick.group_mode(ei(spark, sf), ["opsin", "region", "brain_id"], "stim_duration", "mode_duration")
    return d.select("opsin", "region", "brain_id", big("mode_duration", "mode_duration"))


@query("a8_distinct", with_("ei", then="SELECT DISTINCT filename_plus10, region FROM ei"))
def a8(spark, sf):
    return ei(spark, sf).select("filename_plus10", "region").distinct()


@query("a9_none_true", with_("peaks", then="SELECT cell, NOT bool_or(actual_peak > 100) AS all_false FROM peaks GROUP BY 1"))
def a9(spark, sf):
    return summarise.none_true(peaks(spark, sf).withColumn("flag", F.col("actual_peak") > 100), ["cell"], "flag")


@query(
    "a10_gather_vector",
    "SELECT flag, piece, list(q ORDER BY q) AS vec FROM (SELECT l_returnflag AS flag, l_quantity AS q,"
    " (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1) // 1000 AS piece FROM lineitem) GROUP BY 1, 2",
)
def a10(spark, sf):
    from axonframe.operators.ordered import gather_pieces

    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"))
    return gather_pieces(d, ["flag"], "q", 1000)


HIST_SQL = (
    "SELECT region, CAST(least(floor((mean - lo) / ((hi - lo) / 30e0)), 29) AS INTEGER) AS bin, " + b("count(*)") + " AS count"
    " FROM roi JOIN (SELECT region, min(mean) AS lo, max(mean) AS hi FROM roi GROUP BY 1) USING (region) GROUP BY 1, 2"
)


@query("a11_histogram", with_("roi", then=HIST_SQL))
def a11(spark, sf):
    d = summarise.histogram(surrogate(spark, sf, "roi"), ["region"], "mean", 30)
    return d.select("region", "bin", big("count", "count"))


@query(
    "a12_kernel_density",
    with_(
        "roi",
        s="SELECT region, count(*) AS n, min(mean) AS lo, max(mean) AS hi, 0.9e0 * least(stddev_samp(mean), (quantile_cont(mean, 0.75) - quantile_cont(mean, 0.25)) / 1.34e0)"
        " * pow(count(*), -0.2e0) AS bw FROM roi GROUP BY 1",
        g="SELECT region, n, bw, lo - 3 * bw AS x0, (hi - lo + 6 * bw) / 31e0 AS dx FROM s",
        # linear binning: weights of the two nearest points of a grid 64 times as fine
        v="SELECT region, (mean - x0) * 64 / dx AS place FROM roi JOIN g USING (region)",
        w="SELECT region, floor(place) AS bin, floor(place) + 1 - place AS w FROM v UNION ALL SELECT region, floor(place) + 1, place - floor(place) FROM v",
        bn="SELECT region, bin, sum(w) AS w FROM w GROUP BY 1, 2",
        then=f"SELECT region, CAST(k AS INTEGER) AS grid, {r('max(x0 + k * dx)')} AS x, {r('sum(w * exp(-pow((x0 + k * dx - x0 - bin * dx / 64) / bw, 2) / 2)) / max(n * bw * sqrt(2 * pi()))', 8)} AS density"
        " FROM bn JOIN g USING (region), range(0, 32) t(k) GROUP BY 1, 2",
    ),
)
def a12(spark, sf):
    d = summarise.density(surrogate(spark, sf, "roi"), ["region"], "mean", points=32)
    return d.select("region", "grid", num("x", "x"), num("density", "density", 8))


@query(
    "a13_box_stats",
    with_(
        "ei",
        q="SELECT region, quantile_cont(amp_plus10, 0.25) AS q1, quantile_cont(amp_plus10, 0.5) AS med, quantile_cont(amp_plus10, 0.75) AS q3 FROM ei GROUP BY 1",
        j="SELECT e.region, e.amp_plus10 AS v, q1, med, q3, e.amp_plus10 BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS ok FROM ei e JOIN q ON e.region IS NOT DISTINCT FROM q.region WHERE e.amp_plus10 IS NOT NULL",
        then=f"SELECT region, {r('max(q1)')} AS q1, {r('max(med)')} AS median, {r('max(q3)')} AS q3, {r('min(CASE WHEN ok THEN v END)')} AS whisker_low,"
        f" {r('max(CASE WHEN ok THEN v END)')} AS whisker_high, {b('count_if(NOT ok)')} AS n_outliers FROM j GROUP BY 1",
    ),
)
def a13(spark, sf):
    d = summarise.box_stats(ei(spark, sf), ["region"], "amp_plus10")
    return d.select("region", *[num(c, c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], big("n_outliers", "n_outliers"))


@query(
    "a14_linear_fit",
    with_(
        "ei",
        then=f"SELECT region, {r('regr_slope(amp_plus10, rough_ap)')} AS slope, {r('regr_intercept(amp_plus10, rough_ap)')} AS intercept, {r('regr_r2(amp_plus10, rough_ap)')} AS r2,"
        f" {r('sqrt((1 - regr_r2(amp_plus10, rough_ap)) * regr_syy(amp_plus10, rough_ap) / ((regr_count(amp_plus10, rough_ap) - 2) * regr_sxx(amp_plus10, rough_ap)))')} AS slope_se,"
        f" {b('regr_count(amp_plus10, rough_ap)')} AS n FROM ei GROUP BY 1",
    ),
)
def a14(spark, sf):
    d = summarise.linear_fit(ei(spark, sf), ["region"], "amp_plus10", "rough_ap")
    return d.select("region", *[num(c, c) for c in ("slope", "intercept", "r2", "slope_se")], big("n", "n"))


@query(
    "a15_pearson",
    with_("ei", then=f"SELECT region, {r('corr(amp_plus10, rough_ap)')} AS r, {b('count_if(amp_plus10 IS NOT NULL AND rough_ap IS NOT NULL)')} AS n FROM ei GROUP BY 1"),
)
def a15(spark, sf):
    return summarise.correlation(ei(spark, sf), ["region"], "amp_plus10", "rough_ap").select("region", num("r", "r"), big("n", "n"))


@query(
    "a16_patch_ratio",
    with_(
        "px",
        then=f"SELECT image_id, {r('avg(v) FILTER (patch AND m)')} AS mean_patch, {r('avg(v) FILTER (NOT patch AND m)')} AS mean_interpatch,"
        f" {r('avg(v) FILTER (patch AND m) / nullif(avg(v) FILTER (NOT patch AND m), 0)')} AS ratio FROM px GROUP BY 1",
    ),
)
def a16(spark, sf):
    d = summarise.masked_ratio(pixels(spark, sf), ["image_id"], "v", F.col("patch") & F.col("m"), ~F.col("patch") & F.col("m"))
    return d.select("image_id", *[num(c, c) for c in ("mean_patch", "mean_interpatch", "ratio")])


@query(
    "a17_normalise_by_patch",
    with_(
        "px",
        p="SELECT image_id, avg(v) AS pm FROM px WHERE patch GROUP BY 1",
        then=f"SELECT image_id, y, x, {r('CASE WHEN pm > 0 THEN v / pm ELSE v END')} AS v FROM px LEFT JOIN p USING (image_id)",
    ),
)
def a17(spark, sf):
    d = summarise.normalise_by_mean(pixels(spark, sf), ["image_id"], "v", F.col("patch"))
    return d.select("image_id", "y", "x", num("v", "v"))


@query("a18_percentile_bounds", with_("px", then=f"SELECT image_id, {r('quantile_cont(v, 0.025)')} AS low, {r('quantile_cont(v, 0.975)')} AS high FROM px GROUP BY 1"))
def a18(spark, sf):
    return summarise.percentile_bounds(pixels(spark, sf), ["image_id"], "v").select("image_id", num("low", "low"), num("high", "high"))


@query(
    "a19_extent",
    with_(
        "px",
        then=f"SELECT image_id, {b('min(y)')} AS min_row, {b('min(x)')} AS min_col, {b('max(y) + 1')} AS max_row, {b('max(x) + 1')} AS max_col, {b('count(*)')} AS area"
        " FROM px WHERE v > 150 GROUP BY 1",
    ),
)
def a19(spark, sf):
    d = summarise.extent(pixels(spark, sf).filter("v > 150"), ["image_id"])
    return d.select("image_id", *[big(c, c) for c in ("min_row", "min_col", "max_row", "max_col", "area")])
