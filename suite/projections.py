"""Projections, predicates, scalar functions and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonframe.functions import scalar, textparse
from axonframe.operators import clean, reshape
from axonframe.sources import files as filesrc
from suite.base import b, big, num, query, r, table
from suite.surrogates import surrogate, with_

ID = "filename_plus10, filename_minus55, o1, o2, o3"
ID_COLS = ["filename_plus10", "filename_minus55", "o1", "o2", "o3"]


def ei(spark, sf):
    return surrogate(spark, sf, "ei")


def peaks(spark, sf):
    return surrogate(spark, sf, "peaks")


@query(
    "p1_ratio_arithmetic",
    with_(
        "ei",
        then=f"SELECT {ID}, {r('amp_plus10 / -amp_minus55')} AS ei_balance, {r('ln(amp_plus10 / -amp_minus55)')} AS log_ei,"
        f" {r('abs(amp_plus10 / amp_minus55)')} AS abs_ei, {r('stim_duration * 1000e0')} AS duration_ms FROM ei",
    ),
)
def p1(spark, sf):
    bal = scalar.ratio("amp_plus10", -F.col("amp_minus55"))
    return ei(spark, sf).select(
        *ID_COLS, num(bal, "ei_balance"), num(scalar.safe_log(bal), "log_ei"),
        num(F.abs(scalar.ratio("amp_plus10", "amp_minus55")), "abs_ei"), num(F.col("stim_duration") * 1000.0, "duration_ms"),
    )


@query(
    "p2_composite_key",
    with_(
        "ei",
        then="SELECT concat_ws('_', CAST(brain_id AS VARCHAR), CAST(slice_id AS VARCHAR), CAST(cell_id AS VARCHAR), coalesce(region, 'NA')) AS cell_key,"
        f" {b('count(*)')} AS n FROM ei GROUP BY 1",
    ),
)
def p2(spark, sf):
    return ei(spark, sf).groupBy(scalar.paste("brain_id", "slice_id", "cell_id", "region").alias("cell_key")).agg(big(F.count("*"), "n"))


@query(
    "p3_conditional_label",
    with_(
        "ei",
        then=f"SELECT {ID}, CASE WHEN region IS NULL THEN NULL WHEN color = 'blue' AND region = 'ACC' THEN 'ACC' ELSE 'RSC' END AS source_region FROM ei",
    ),
)
def p3(spark, sf):
    cond = (F.col("region") == "ACC") & F.when(F.col("region").isNotNull(), F.col("color") == "blue")
    return ei(spark, sf).select(*ID_COLS, scalar.if_else(cond, F.lit("ACC"), F.lit("RSC")).alias("source_region"))


@query(
    "p4_amplitude_band",
    with_("ei", then=f"SELECT {ID}, {r('amp_minus55')} AS amp_minus55 FROM ei WHERE amp_minus55 < -10 AND amp_minus55 > -50"),
)
def p4(spark, sf):
    return ei(spark, sf).filter("amp_minus55 < -10 AND amp_minus55 > -50").select(*ID_COLS, num("amp_minus55", "amp_minus55"))


@query(
    "p5_quality_filter",
    with_("ei", then=f"SELECT {ID}, {r('rough_ap')} AS rough_ap FROM ei WHERE amp_minus55 < -50 AND stim_power = 100 AND stim_duration > 2 AND stim_duration <> 5"),
)
def p5(spark, sf):
    q = (F.col("amp_minus55") < -50) & (F.col("stim_power") == 100) & (F.col("stim_duration") > 2) & (F.col("stim_duration") != 5)
    return ei(spark, sf).filter(q).select(*ID_COLS, num("rough_ap", "rough_ap"))


@query(
    "p6_set_membership",
    with_("ei", then=f"SELECT region, color, {b('count(*)')} AS n FROM ei WHERE color = 'blue' AND region IN ('ACC', 'RSC') AND stim_duration IN (1, 3, 5) GROUP BY 1, 2"),
)
def p6(spark, sf):
    d = ei(spark, sf).filter((F.col("color") == "blue") & F.col("region").isin("ACC", "RSC") & F.col("stim_duration").isin(1, 3, 5))
    return d.groupBy("region", "color").agg(big(F.count("*"), "n"))


@query(
    "p7_null_filters",
    with_("ei", then=f"SELECT {ID}, region FROM ei WHERE amp_plus10 IS NOT NULL AND rough_ap IS NOT NULL AND NOT (region = 'RSC')"),
)
def p7(spark, sf):
    d = ei(spark, sf).dropna(subset=["amp_plus10", "rough_ap"]).filter(~(F.col("region") == "RSC"))
    return d.select(*ID_COLS, "region")


@query(
    "p8_between",
    with_("peaks", then=f"SELECT event_id, {r('estimated_peak')} AS estimated_peak FROM peaks WHERE estimated_peak BETWEEN 3 AND 7"),
)
def p8(spark, sf):
    return peaks(spark, sf).filter(F.col("estimated_peak").between(3, 7)).select("event_id", num("estimated_peak", "estimated_peak"))


@query(
    "p9_regex_predicates",
    with_(
        "peaks",
        then="SELECT event_id, regexp_matches(log, '(?i)PTX') AS ptx, regexp_matches(log, '(?i)4\\s*-?\\s*AP') AS ap4,"
        " contains(log, '-75 mV') AS hold75, regexp_matches(log, '^R_1') AS r1 FROM peaks",
    ),
)
def p9(spark, sf):
    return peaks(spark, sf).select(
        "event_id", F.col("log").rlike(textparse.PTX).alias("ptx"), F.col("log").rlike(textparse.FOUR_AP).alias("ap4"),
        F.col("log").contains("-75 mV").alias("hold75"), F.col("log").rlike("^R_1").alias("r1"),
    )


@query("p10_drop_rename", with_("roi", then=f"SELECT event_id, region AS area, {r('mean')} AS intensity FROM roi"))
def p10(spark, sf):
    d = surrogate(spark, sf, "roi").drop("axis", "roi_id", "mouse_id").withColumnRenamed("region", "area")
    return d.select("event_id", "area", num("mean", "intensity"))


@query(
    "p11_condition_label",
    with_("peaks", then="SELECT event_id, concat(CASE WHEN contains(log, '-75 mV') THEN '-75 mV' ELSE '-55 mV' END, ' ', 'K') AS cond FROM peaks"),
)
def p11(spark, sf):
    hold = F.when(F.col("log").contains("-75 mV"), "-75 mV").otherwise("-55 mV")
    return peaks(spark, sf).withColumn("intra", F.lit("K")).select("event_id", F.concat(hold, F.lit(" "), "intra").alias("cond"))


@query(
    "p12_numeric_coercion",
    f"SELECT doc_id, {r("TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN CAST(n_chars AS VARCHAR) || '.5' ELSE source END AS DOUBLE)")} AS a, {r('TRY_CAST(CAST(n_chars AS VARCHAR) AS DOUBLE)')} AS b FROM documents",
)
def p12(spark, sf):
    mixed = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.col("n_chars").cast("string"), F.lit(".5"))).otherwise(F.col("source"))
    d = table(spark, sf, "documents").select("doc_id", mixed.alias("a"), F.col("n_chars").cast("string").alias("b"))
    return clean.to_numeric(d, ["a", "b"]).select("doc_id", num("a", "a"), num("b", "b"))


@query(
    "p13_recode",
    with_("roi", then="SELECT event_id, CASE region WHEN 'click' THEN 'ACSF' WHEN 'view' THEN 'PTX 25 uM' ELSE region END AS label FROM roi"),
)
def p13(spark, sf):
    return surrogate(spark, sf, "roi").select("event_id", scalar.recode("region", {"click": "ACSF", "view": "PTX 25 uM"}).alias("label"))


LEVELS = ["click", "view", "purchase", "signup", "error"]


@query(
    "p14_factor_levels",
    with_(
        "roi",
        then="SELECT region, CAST(list_position(['click','view','purchase','signup','error'], region) - 1 AS INTEGER) AS ord,"
        f" CAST(5 - list_position(['click','view','purchase','signup','error'], region) AS INTEGER) AS rev_ord, {b('count(*)')} AS n FROM roi GROUP BY ALL",
    ),
)
def p14(spark, sf):
    d = surrogate(spark, sf, "roi").groupBy("region").agg(big(F.count("*"), "n"))
    return d.select("region", scalar.level_ordinal("region", LEVELS).alias("ord"), scalar.level_ordinal("region", LEVELS, True).alias("rev_ord"), "n")


@query("p15_sign_flip", with_("ei", then=f"SELECT {ID}, {r('-amp_minus55')} AS amp FROM ei"))
def p15(spark, sf):
    return ei(spark, sf).select(*ID_COLS, num(-F.col("amp_minus55"), "amp"))


@query(
    "p16_angles",
    with_(
        "roi",
        then=f"SELECT event_id, {r('fmod(fmod(mean - 100, 180) + 180, 180)')} AS folded, {r('radians(mean)')} AS rad, {r('degrees(mean)', 4)} AS deg,"
        f" {r('roi_id + 5 * cos(radians(mean))')} AS end_x, {r('mouse_id + 5 * sin(radians(mean))')} AS end_y FROM roi",
    ),
)
def p16(spark, sf):
    rad = F.radians("mean")
    end = scalar.polar_endpoint("roi_id", "mouse_id", F.lit(5.0), rad)
    return surrogate(spark, sf, "roi").select(
        "event_id", num(scalar.fold_degrees(F.col("mean") - 100), "folded"), num(rad, "rad"), num(F.degrees("mean"), "deg", 4),
        num(end.getField("x"), "end_x"), num(end.getField("y"), "end_y"),
    )


@query(
    "p18_row_struct",
    with_(
        "peaks",
        then="SELECT event_id, regexp_extract(log, 'R_(\\d+\\.?\\d*) A (\\d+)% (\\d+\\.?\\d*) ms', 2) AS power,"
        " regexp_extract(log, 'R_(\\d+\\.?\\d*) A (\\d+)% (\\d+\\.?\\d*) ms', 3) AS duration FROM peaks",
    ),
)
def p18(spark, sf):
    s = textparse.stimulus_percent("log")
    return peaks(spark, sf).select("event_id", s.alias("s")).select("event_id", F.col("s.r_power").alias("power"), F.col("s.r_duration").alias("duration"))


# --- scalar functions ------------------------------------------------------------------------------


@query(
    "f1_substrings",
    "SELECT doc_id, left(text, 5) AS head, right(text, 1) AS tail, concat_ws('_', left(text, 5), right(lang, 1)) AS cell_id FROM documents",
)
def f1(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", textparse.left("text", 5).alias("head"), textparse.right("text", 1).alias("tail"),
        scalar.paste(textparse.left("text", 5), textparse.right("lang", 1)).alias("cell_id"),
    )


@query(
    "f2_detect",
    f"SELECT lang, {b('count_if(contains(text, chr(10)))')} AS multi_line, {b('count_if(regexp_matches(text, $$(?i)the$$))')} AS with_the FROM documents GROUP BY 1",
)
def f2(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        big(F.count_if(F.col("text").contains("\n")), "multi_line"), big(F.count_if(F.col("text").rlike("(?i)the")), "with_the")
    )


@query(
    "f3_extract",
    with_(
        "peaks",
        then="SELECT event_id, nullif(regexp_extract(log, 'RMP -?\\d+ mV'), '') AS whole, nullif(regexp_extract(log, 'RMP (-?\\d+) mV', 1), '') AS grp FROM peaks",
    ),
)
def f3(spark, sf):
    return peaks(spark, sf).select(
        "event_id", textparse.extract("log", r"RMP -?\d+ mV").alias("whole"), textparse.extract("log", r"RMP (-?\d+) mV", 1).alias("grp")
    )


STIM = r"\b[A-Z]_\d+ A (\d+\.?\d*%?|\d*\.?\d+%?) \d+\.?\d* ms\b"


@query(
    "f4_stim_descriptors",
    with_(
        "peaks",
        then=f"SELECT event_id, regexp_extract_all(log, '{STIM}')[1] AS stim1, regexp_extract_all(log, '{STIM}')[2] AS stim2,"
        f" regexp_extract_all(log, '{STIM}')[3] AS stim3 FROM peaks",
    ),
)
def f4(spark, sf):
    m = textparse.stim_descriptors("log")
    return peaks(spark, sf).select("event_id", *[textparse.nth(m, k).alias(f"stim{k}") for k in (1, 2, 3)])


@query(
    "f5_concentration",
    with_(
        "peaks",
        then=f"SELECT event_id, {r('TRY_CAST(nullif(regexp_extract(log, $$(?i)PTX\\s+([0-9]+(?:\\.[0-9]+)?)\\s*(uM|mM)$$, 1), $$$$) AS DOUBLE)')} AS ptx_conc,"
        f" {r('TRY_CAST(nullif(regexp_extract(log, $$(?i)4\\s*-?\\s*AP\\s+([0-9]+(?:\\.[0-9]+)?)\\s*(uM|mM)$$, 1), $$$$) AS DOUBLE)')} AS ap4_conc,"
        " nullif(regexp_extract(log, '(?i)4\\s*-?\\s*AP\\s+([0-9]+(?:\\.[0-9]+)?)\\s*(uM|mM)', 2), '') AS ap4_unit FROM peaks",
    ),
)
def f5(spark, sf):
    ptx, ap4 = textparse.concentration("log", textparse.PTX), textparse.concentration("log", textparse.FOUR_AP)
    return peaks(spark, sf).select(
        "event_id", num(ptx.getField("value"), "ptx_conc"), num(ap4.getField("value"), "ap4_conc"), ap4.getField("unit").alias("ap4_unit")
    )


@query(
    "f6_stimulus_percent",
    with_(
        "peaks",
        then="SELECT event_id, regexp_extract(m, '_(\\d+\\.?\\d*) A (\\d+)% (\\d+\\.?\\d*) ms', 2) AS r_power,"
        " regexp_extract(m, '_(\\d+\\.?\\d*) A (\\d+)% (\\d+\\.?\\d*) ms', 3) AS r_duration,"
        " CAST(NULL AS VARCHAR) AS b_power, CAST(NULL AS VARCHAR) AS b_duration"
        " FROM (SELECT event_id, list_last(regexp_extract_all(log, 'R_(\\d+\\.?\\d*) A (\\d+)% (\\d+\\.?\\d*) ms')) AS m FROM peaks)",
    ),
)
def f6(spark, sf):
    return peaks(spark, sf).select("event_id", textparse.stimulus_percent("log").alias("s")).select("event_id", "s.*")


@query(
    "f7_stimulus_plain",
    with_(
        "peaks",
        plain="SELECT event_id, concat(replace(log, '%', ''), ' ', replace(log, '%', '')) AS log FROM peaks",
        m="SELECT event_id, list_last(regexp_extract_all(log, 'R_\\d+ A (\\d+\\.?\\d*) (\\d+\\.?\\d*) ms')) AS mr,"
        " list_last(regexp_extract_all(log, 'B_\\d+ A (\\d+\\.?\\d*) (\\d+\\.?\\d*) ms')) AS mb FROM plain",
        then="SELECT event_id, " + ", ".join(
            f"regexp_extract(m{p}, ' A (\\d+\\.?\\d*) (\\d+\\.?\\d*) ms', {g}) AS {p}_{n}" for p in "rb" for g, n in ((1, "power"), (2, "duration"))
        ) + " FROM m",
    ),
)
def f7(spark, sf):
    plain = F.replace("log", F.lit("%"), F.lit(""))
    return (
        peaks(spark, sf)
        .select("event_id", F.concat(plain, F.lit(" "), plain).alias("log"))
        .select("event_id", textparse.stimulus_plain("log").alias("s"))
        .select("event_id", "s.*")
    )


@query(
    "f8_colour_order",
    with_(
        "peaks",
        rev="SELECT event_id, CASE event_id % 3 WHEN 0 THEN log WHEN 1 THEN concat('B_9 ', log) ELSE substr(log, strpos(log, 'IT_')) END AS log FROM peaks",
        then="SELECT event_id, CASE WHEN strpos(log, 'B_') = 0 AND strpos(log, 'R_') = 0 THEN 'None' WHEN strpos(log, 'B_') = 0 THEN 'R'"
        " WHEN strpos(log, 'R_') = 0 THEN 'B' WHEN strpos(log, 'B_') < strpos(log, 'R_') THEN 'B' ELSE 'R' END AS first_colour FROM rev",
    ),
)
def f8(spark, sf):
    log = F.expr("CASE event_id % 3 WHEN 0 THEN log WHEN 1 THEN concat('B_9 ', log) ELSE substring(log, instr(log, 'IT_')) END")
    return peaks(spark, sf).select("event_id", textparse.colour_order(log).alias("first_colour"))


@query("f9_interval", with_("peaks", then="SELECT event_id, CAST(regexp_extract(log, 'IT_(\\d+) ms', 1) AS INTEGER) AS interval_ms FROM peaks"))
def f9(spark, sf):
    return peaks(spark, sf).select("event_id", textparse.interval_ms("log").alias("interval_ms"))


@query(
    "f10_substances",
    with_(
        "peaks",
        u="SELECT event_id, concat(upper(log), CASE WHEN event_id % 5 = 0 THEN ' NBQX AP-V' ELSE '' END) AS log FROM peaks",
        then="SELECT event_id, coalesce(nullif(concat_ws(', ', CASE WHEN contains(log, 'PTX') THEN 'PTX' END,"
        " CASE WHEN contains(log, 'NBQX') THEN 'NBQX' END, CASE WHEN contains(log, 'AP-V') THEN 'AP-V' END), ''), 'None') AS substances FROM u",
    ),
)
def f10(spark, sf):
    log = F.expr("concat(upper(log), CASE WHEN event_id % 5 = 0 THEN ' NBQX AP-V' ELSE '' END)")
    return peaks(spark, sf).select("event_id", log.alias("log")).select("event_id", textparse.substances("log").alias("substances"))


@query(
    "f11_resting_potential",
    with_(
        "peaks",
        then="SELECT event_id, CASE WHEN v IS NOT NULL THEN cell END AS cell, CAST(v AS INTEGER) AS rmp_mv"
        " FROM (SELECT event_id, cell, nullif(regexp_extract(log, 'RMP\\s(-?\\d+)\\smV', 1), '') AS v FROM peaks)",
    ),
)
def f11(spark, sf):
    return peaks(spark, sf).select("event_id", textparse.resting_potential("log", "cell").alias("s")).select("event_id", "s.*")


@query(
    "f16_math",
    with_(
        "roi",
        then=f"SELECT event_id, {r('ln(mean + 1)')} AS ln1, {r('sqrt(mean)')} AS root, {b('ceil(mean)')} AS up, {r('atan2(mean, 7)')} AS angle,"
        f" {r('exp(-mean / 100)')} AS decay, {b('pow(2, ceil(log2(mean + 1)))')} AS pow2, {b('roi_id % 7')} AS modulo FROM roi",
    ),
)
def f16(spark, sf):
    return surrogate(spark, sf, "roi").select(
        "event_id", num(scalar.safe_log(F.col("mean") + 1), "ln1"), num(F.sqrt("mean"), "root"), big(F.ceil("mean"), "up"),
        num(F.atan2("mean", F.lit(7.0)), "angle"), num(F.exp(-F.col("mean") / 100), "decay"),
        scalar.next_power_of_two(F.col("mean") + 1).alias("pow2"), big(F.col("roi_id") % 7, "modulo"),
    )


@query(
    "f17_path_parts",
    with_("files", then="SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/]*$') AS base, concat_ws('/', '.', regexp_extract(path, '[^/]*$')) AS joined FROM files"),
)
def f17(spark, sf):
    d, n = scalar.dirname("path"), scalar.basename("path")
    return surrogate(spark, sf, "files").select("path", d.alias("dir"), n.alias("base"), F.concat_ws("/", F.lit("."), n).alias("joined"))


@query("f18_near_zero", with_("roi", then="SELECT event_id, abs(mean) <= 1e-6 AS near_zero FROM roi"))
def f18(spark, sf):
    return surrogate(spark, sf, "roi").select("event_id", scalar.near_zero("mean").alias("near_zero"))


@query(
    "f19_number_format",
    with_("peaks", then="SELECT event_id, printf('%.3f', actual_peak) AS three, concat(CAST(CAST(round(interval_s * 1000) AS BIGINT) AS VARCHAR), ' ms') AS label FROM peaks"),
)
def f19(spark, sf):
    return peaks(spark, sf).select("event_id", F.format_string("%.3f", "actual_peak").alias("three"), scalar.milliseconds_label("interval_s").alias("label"))


@query(
    "f20_significance_stars",
    with_(
        "roi",
        p="SELECT event_id, mean / 1000 AS p FROM roi",
        then="SELECT event_id, CASE WHEN p <= 1e-4 THEN '****' WHEN p <= 1e-3 THEN '***' WHEN p <= 1e-2 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS stars FROM p",
    ),
)
def f20(spark, sf):
    return surrogate(spark, sf, "roi").select("event_id", scalar.significance_stars(F.col("mean") / 1000).alias("stars"))


@query(
    "f21_term_renaming",
    with_("roi", then=f"SELECT CASE WHEN region = 'signup' THEN 'AP coord' ELSE region END AS term, {b('count(*)')} AS n FROM roi GROUP BY 1"),
)
def f21(spark, sf):
    return surrogate(spark, sf, "roi").groupBy(scalar.recode("region", {"signup": "AP coord"}).alias("term")).agg(big(F.count("*"), "n"))


# --- reshaping -------------------------------------------------------------------------------------


@query(
    "u1_bind_rows",
    with_(
        "ei",
        then=f"SELECT {ID}, region, CAST(NULL AS VARCHAR) AS ap_region FROM ei WHERE region = 'ACC' UNION ALL SELECT {ID}, NULL AS region, ap_region FROM ei WHERE region = 'RSC'",
    ),
)
def u1(spark, sf):
    d = ei(spark, sf)
    return reshape.bind_rows(d.filter("region = 'ACC'").select(*ID_COLS, "region"), d.filter("region = 'RSC'").select(*ID_COLS, "ap_region"))


@query("u2_pooled_groups", with_("px", then=f"SELECT patch, {b('count(*)')} AS n, {r('sum(v)', 3)} AS total FROM px GROUP BY 1"))
def u2(spark, sf):
    from suite.surrogates import pixels

    return pixels(spark, sf).groupBy("patch").agg(big(F.count("*"), "n"), num(F.sum("v"), "total", 3))


@query(
    "u3_pivot_longer",
    with_("peaks", then=f"SELECT event_id, name, {r('val')} AS val FROM (UNPIVOT (SELECT event_id, actual_peak, estimated_peak FROM peaks) ON actual_peak, estimated_peak INTO NAME name VALUE val)"),
)
def u3(spark, sf):
    d = reshape.pivot_longer(peaks(spark, sf), ["event_id"], ["actual_peak", "estimated_peak"], "name", "val")
    return d.select("event_id", "name", num("val", "val"))


@query(
    "u4_pivot_wider",
    with_(
        "peaks",
        m="SELECT cell, interval_s, avg(actual_peak) AS v FROM peaks GROUP BY 1, 2",
        then="SELECT cell, " + ", ".join(f"{r(f'max(CASE WHEN interval_s = {lv}e0 THEN v END)')} AS {nm}" for lv, nm in ((0.025, "i25"), (0.05, "i50"), (0.1, "i100"))) + " FROM m GROUP BY 1",
    ),
)
def u4(spark, sf):
    m = peaks(spark, sf).groupBy("cell", "interval_s").agg(F.avg("actual_peak").alias("v"))
    names = ["i25", "i50", "i100"]
    return reshape.pivot_wider(m, ["cell"], "interval_s", "v", [0.025, 0.05, 0.1], names).select("cell", *[num(n, n) for n in names])


@query(
    "u5_complete_cases",
    with_(
        "peaks",
        m="SELECT cell, interval_s, avg(actual_peak) AS v FROM peaks WHERE interval_s > 0 GROUP BY 1, 2",
        full_cells="SELECT cell FROM m GROUP BY 1 HAVING count(*) = 4",
        then=f"SELECT cell, interval_s, {r('v')} AS v FROM m SEMI JOIN full_cells USING (cell)",
    ),
)
def u5(spark, sf):
    m = peaks(spark, sf).filter("interval_s > 0").groupBy("cell", "interval_s").agg(F.avg("actual_peak").alias("v"))
    return reshape.complete_cases(m, ["cell"], "interval_s", "v", [0.025, 0.05, 0.1, 0.25]).select("cell", "interval_s", num("v", "v"))


@query(
    "u6_separate",
    with_(
        "roi",
        l="SELECT event_id, concat_ws('_', CAST(mouse_id AS VARCHAR), region, CASE WHEN event_id % 2 = 0 THEN 'patch' END) AS label FROM roi",
        then="SELECT event_id, split_part(label, '_', 1) AS mouse, split_part(label, '_', 2) AS region, nullif(split_part(label, '_', 3), '') AS kind FROM l",
    ),
)
def u6(spark, sf):
    label = F.concat_ws("_", F.col("mouse_id").cast("string"), "region", F.when(F.col("event_id") % 2 == 0, "patch"))
    d = surrogate(spark, sf, "roi").select("event_id", label.alias("label"))
    return reshape.separate(d, "label", ["mouse", "region", "kind"], "_").drop("label")


@query(
    "u7_unnest",
    with_("peaks", then=f"SELECT event_id, unnest(regexp_extract_all(log, '{STIM}')) AS stim FROM peaks"),
)
def u7(spark, sf):
    return peaks(spark, sf).select("event_id", F.explode(textparse.stim_descriptors("log")).alias("stim"))


@query(
    "u8_grid",
    f"SELECT {b('image_id')} AS image_id, {b('gy')} AS gy, {b('gx')} AS gx FROM (SELECT DISTINCT CAST(floor(vec_id / 64e0) AS BIGINT) AS image_id FROM embeddings)"
    " CROSS JOIN range(0, 33, 8) a(gy) CROSS JOIN range(0, 33, 8) c(gx)",
)
def u8(spark, sf):
    from suite.surrogates import strips

    d = strips(spark, sf).select("image_id").distinct()
    axis = (F.lit(0), F.lit(32), F.lit(8))
    return reshape.grid(d, {"gy": axis, "gx": axis}).select("image_id", big("gy", "gy"), big("gx", "gx"))


# --- column hygiene --------------------------------------------------------------------------------


@query(
    "s2_text_then_cast",
    f"SELECT o_orderkey, {r('o_totalprice')} AS total, CAST(NULL AS DOUBLE) AS priority FROM orders",
)
def s2(spark, sf):
    """All columns as text, then cast; the priority labels are no numbers."""
    d = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("total"), F.col("o_orderpriority").alias("priority"))
    return clean.to_numeric(d, ["total", "priority"]).select("o_orderkey", num("total", "total"), "priority")


@query("s6_clean_names", f"SELECT o_orderkey AS order_key, {r('o_totalprice')} AS actual_peak_value FROM orders")
def s6(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("OrderKey"), F.col("o_totalprice").alias("Actual Peak Value"), F.lit(1).alias("...1"))
    d = clean.clean_names(clean.drop_unnamed(d))
    return d.select("order_key", num("actual_peak_value", "actual_peak_value"))


@query("s7_any_of", "SELECT o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS log FROM orders")
def s7(spark, sf):
    return clean.any_of(table(spark, sf, "orders"), {"o_orderkey": "bigint", "o_orderstatus": "string", "log": "string"})


@query(
    "j8_same_folder_files",
    with_(
        "files",
        f="SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files",
        then="SELECT a.path AS anchor, e.path AS sibling FROM f a JOIN f e ON a.dir = e.dir WHERE NOT contains(a.path, '_edited') AND contains(e.path, '_edited')",
    ),
)
def j8(spark, sf):
    f = surrogate(spark, sf, "files")
    return filesrc.siblings(f.filter(~F.col("path").contains("_edited")), f, r"^merged_mean_peak_edited\.csv$")


@query(
    "s9_find_by_pattern",
    with_("files", then=r"SELECT path FROM files WHERE regexp_matches(path, '/merged_mean_peak_edited\.csv$')"),
)
def s9(spark, sf):
    return filesrc.find_by_pattern(surrogate(spark, sf, "files"), r"merged_mean_peak_edited\.csv$")


# --- file catalogue --------------------------------------------------------------------------------


@query(
    "s4a_one_per_folder",
    with_(
        "files",
        then="SELECT dir, path FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, path, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1)"
        " ORDER BY contains(path, '_edited') DESC, path) AS rn FROM files) WHERE rn = 1",
    ),
)
def s4a(spark, sf):
    return filesrc.one_per_folder(surrogate(spark, sf, "files"))


@query(
    "s4b_prefer_edited",
    with_(
        "files",
        then="SELECT regexp_extract(f.path, '^(.*)/[^/]*$', 1) AS dir, coalesce(e.path, f.path) AS path FROM files f"
        " LEFT JOIN files e ON e.path = replace(f.path, 'merged_mean_peak.csv', 'merged_mean_peak_edited.csv') WHERE NOT contains(f.path, '_edited')",
    ),
)
def s4b(spark, sf):
    return filesrc.prefer_edited(surrogate(spark, sf, "files"))


@query(
    "s5_keep_existing",
    with_(
        "files",
        wanted="SELECT DISTINCT concat('/d', CAST(CAST(floor(p_partkey / 3e0) AS BIGINT) AS VARCHAR), '/merged_mean_peak_edited.csv') AS path FROM part",
        then="SELECT path FROM wanted SEMI JOIN files USING (path)",
    ),
)
def s5(spark, sf):
    path = F.concat(F.lit("/d"), F.floor(F.col("p_partkey") / 3.0).cast("string"), F.lit("/merged_mean_peak_edited.csv"))
    return filesrc.keep_existing(table(spark, sf, "part").select(path.alias("path")).distinct(), surrogate(spark, sf, "files"))


@query(
    "s13_path_keys",
    "WITH p AS (SELECT DISTINCT concat('./', CAST(p_size AS VARCHAR), '/', p_brand, '/RSC_', CAST(p_partkey AS VARCHAR), '.tif') AS path FROM part)"
    " SELECT path, split_part(path, '/', 2) AS animal, split_part(path, '/', 3) AS region, replace(split_part(path, '/', 4), '.tif', '') AS area,"
    " replace(list_last(string_split(path, '_')), '.tif', '') AS id FROM p",
)
def s13(spark, sf):
    path = F.concat(F.lit("./"), F.col("p_size").cast("string"), F.lit("/"), "p_brand", F.lit("/RSC_"), F.col("p_partkey").cast("string"), F.lit(".tif"))
    return filesrc.path_keys(table(spark, sf, "part").select(path.alias("path")).distinct())


@query("s15_distinct_snippet", with_("ei", then="SELECT DISTINCT concat('\"', CAST(filename_plus10 AS VARCHAR), '\",') AS value FROM ei WHERE amp_minus55 < -70"))
def s15(spark, sf):
    return ei(spark, sf).filter("amp_minus55 < -70").select(F.format_string('"%s",', F.col("filename_plus10")).alias("value")).distinct()
