"""Series, raster, tile and permutation queries on the image surrogate."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from axonframe.operators import components, permute, raster, series, tiles
from axonframe.sources import rasters
from suite.base import b, big, num, query, r, table
from suite.surrogates import pixels, strips, with_

PI = repr(math.pi)

# --- series: each vector is one profile ------------------------------------------------------------

SER = (
    "SELECT vec_id, CAST(i AS BIGINT) AS i, s FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i,"
    " CAST(unnest(embedding) AS DOUBLE) * 4e0 AS s FROM embeddings)"
)


def profiles(spark, sf, offset: float = 0.0):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double") * 4.0 - offset).alias("s")
    )


def long_rows(df, c):
    return df.select("vec_id", F.posexplode(c).alias("i", "o")).select("vec_id", big("i", "i"), num("o", "o"))


DIFF = "SELECT vec_id, i - 1 AS i, s - lag(s) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM ser"


@query("w9_first_difference", with_(ser=SER, d=DIFF, then=f"SELECT vec_id, i, {r('d')} AS o FROM d WHERE i >= 0"))
def w9(spark, sf):
    return long_rows(profiles(spark, sf), series.first_difference("s"))


@query(
    "w10_moving_average",
    with_(ser=SER, then=f"SELECT vec_id, i, {r('sum(s) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5')} AS o FROM ser"),
)
def w10(spark, sf):
    return long_rows(profiles(spark, sf), series.moving_average("s"))


def polynomial_weights() -> str:
    """(pos, k, w): value at ``pos`` of the cubic fitted to an 11-point window with a 1 at ``k``."""
    x = np.arange(11) - 5
    rows = []
    for k in range(11):
        fit = np.polyval(np.polyfit(x, (np.arange(11) == k).astype(float), 3), x)
        rows += [f"({p}, {k}, {w!r})" for p, w in enumerate(map(float, fit))]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(pos, k, w)"


SAVGOL = (
    "SELECT a.vec_id, a.i, sum(wt.w * e.s) AS o FROM (SELECT *, greatest(0, least(i - 5, 53)) AS st FROM ser) a JOIN wt ON wt.pos = a.i - a.st"
    " JOIN ser e ON e.vec_id = a.vec_id AND e.i = a.st + wt.k GROUP BY 1, 2"
)


@query("w11_savitzky_golay", with_(ser=SER, wt=polynomial_weights(), sg=SAVGOL, then=f"SELECT vec_id, i, {r('o')} AS o FROM sg"))
def w11(spark, sf):
    return long_rows(profiles(spark, sf), series.savgol("s"))


LAGS = "SELECT *, lag(s) OVER w AS p, lead(s) OVER w AS n FROM ser WINDOW w AS (PARTITION BY vec_id ORDER BY i)"


@query(
    "w12_half_width",
    with_(
        ser=SER, l=LAGS,
        f="SELECT vec_id, arg_min(i - 1 + (0.5e0 - p) / (s - p), i) AS h FROM l WHERE i >= 1 AND s <= 0.5 GROUP BY 1",
        then=f"SELECT vec_id, {r('h')} AS r_half FROM (SELECT DISTINCT vec_id FROM ser) LEFT JOIN f USING (vec_id)",
    ),
)
def w12(spark, sf):
    return profiles(spark, sf).select("vec_id", num(series.half_width("s"), "r_half"))


@query(
    "w13_local_extrema",
    with_(
        ser=SER, l=LAGS,
        t="SELECT vec_id, arg_min(s, i) AS trough FROM l WHERE s < 0 AND s < p AND s < n GROUP BY 1",
        k="SELECT vec_id, min(i) AS peak FROM l WHERE s > 0 AND s > p AND s > n GROUP BY 1",
        then=f"SELECT vec_id, {r('trough')} AS trough, peak FROM (SELECT DISTINCT vec_id FROM ser) LEFT JOIN t USING (vec_id) LEFT JOIN k USING (vec_id)",
    ),
)
def w13(spark, sf):
    return profiles(spark, sf).select("vec_id", num(series.first_trough_value("s"), "trough"), big(series.first_peak_index("s"), "peak"))


RUN = {
    "neg": "SELECT *, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS island FROM ser WHERE s < 0",
    "run": "SELECT vec_id, arg_min(i, struct_pack(s := s, i := i)) AS pos, min(s) AS v FROM neg n WHERE island = (SELECT min(island) FROM neg m WHERE m.vec_id = n.vec_id) GROUP BY 1",
}


@query("w14_first_negative_run", with_(ser=SER, **RUN, then=f"SELECT vec_id, pos AS trough_index, {r('v')} AS trough FROM (SELECT DISTINCT vec_id FROM ser) LEFT JOIN run USING (vec_id)"))
def w14(spark, sf):
    d = profiles(spark, sf).select("vec_id", series.negative_run_trough("s").alias("t"))
    return d.select("vec_id", big("t.index", "trough_index"), num("t.value", "trough"))


DERIV = {
    "dser": "SELECT vec_id, i - 1 AS i, s - p AS s FROM (SELECT vec_id, i, s, lag(s) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM ser) WHERE i >= 1",
    "wt": polynomial_weights(),
    "sg": "SELECT a.vec_id, a.i, sum(wt.w * e.s) AS o FROM (SELECT *, greatest(0, least(i - 5, 52)) AS st FROM dser) a JOIN wt ON wt.pos = a.i - a.st"
    " JOIN dser e ON e.vec_id = a.vec_id AND e.i = a.st + wt.k GROUP BY 1, 2",
}


@query(
    "w15_second_peak_after_trough",
    with_(
        ser=SER, **RUN, **DERIV,
        c="SELECT run.vec_id, min(CASE WHEN abs(o) <= 1e-6 THEN i END) AS flat, min(CASE WHEN o <= 0 THEN i END) AS fall FROM run JOIN sg ON sg.vec_id = run.vec_id AND sg.i > run.pos GROUP BY 1",
        then="SELECT vec_id, coalesce(flat, fall) AS second_peak FROM (SELECT DISTINCT vec_id FROM ser) LEFT JOIN c USING (vec_id)",
    ),
)
def w15(spark, sf):
    smooth = series.savgol(series.first_difference("s"))
    d = profiles(spark, sf).select("vec_id", series.negative_run_trough("s").alias("t"), smooth.alias("sg"))
    return d.select("vec_id", big(series.second_peak_after("sg", F.col("t.index"), "line"), "second_peak"))


@query(
    "w15_second_peak_radial",
    with_(
        ser=SER, **RUN, **DERIV,
        g="SELECT *, lead(o) OVER (PARTITION BY vec_id ORDER BY i) AS nx FROM sg",
        c="SELECT run.vec_id, min(CASE WHEN abs(o) <= 1e-6 THEN i END) AS flat, min(CASE WHEN sign(o) <> sign(nx) THEN i END) AS turn FROM run JOIN g ON g.vec_id = run.vec_id AND g.i > run.pos GROUP BY 1",
        then="SELECT vec_id, coalesce(flat, turn) + 1 AS second_peak FROM (SELECT DISTINCT vec_id FROM ser) LEFT JOIN c USING (vec_id)",
    ),
)
def w15r(spark, sf):
    smooth = series.savgol(series.first_difference("s"))
    d = profiles(spark, sf).select("vec_id", series.negative_run_trough("s").alias("t"), smooth.alias("sg"))
    return d.select("vec_id", big(series.second_peak_after("sg", F.col("t.index"), "radial"), "second_peak"))


@query(
    "o3_argmin_argmax",
    with_(
        "px", ser=SER,
        a="SELECT image_id, arg_min(struct_pack(y := y, x := x), struct_pack(v := v, y := y, x := x)) AS p, min(v) AS v FROM px GROUP BY 1",
        then=f"SELECT image_id, p.y AS y, p.x AS x, {r('v')} AS v FROM a",
    ),
)
def o3(spark, sf):
    d = pixels(spark, sf).groupBy("image_id").agg(F.min(F.struct("v", "y", "x")).alias("m"))
    return d.select("image_id", "m.y", "m.x", num("m.v", "v"))


@query("o3_argmax_of_array", with_(ser=SER, then="SELECT vec_id, arg_max(i, struct_pack(s := s, i := -i)) AS at FROM ser GROUP BY 1"))
def o3a(spark, sf):
    return profiles(spark, sf).select("vec_id", big(series.argmax_index("s"), "at"))


@query(
    "i14_peak_metrics",
    with_(
        ser=SER, l=LAGS,
        f="SELECT vec_id, arg_min(i - 1 + (0.5e0 - p) / (s - p), i) AS h FROM l WHERE i >= 1 AND s <= 0.5 GROUP BY 1",
        t="SELECT vec_id, arg_min(s, i) AS trough FROM l WHERE s < 0 AND s < p AND s < n GROUP BY 1",
        k="SELECT vec_id, min(i) AS peak FROM l WHERE s > 0 AND s > p AND s > n GROUP BY 1",
        then=f"SELECT vec_id, {r('h')} AS r_half_pixels, {r('h * 0.64e0')} AS r_half_microns, {r('trough')} AS first_negative_amp, {r('peak')} AS second_positive_distance_pixels,"
        f" {r('peak * 0.64e0')} AS second_positive_distance_microns FROM (SELECT DISTINCT vec_id FROM ser) LEFT JOIN f USING (vec_id) LEFT JOIN t USING (vec_id) LEFT JOIN k USING (vec_id)",
    ),
)
def i14(spark, sf):
    d = profiles(spark, sf).select("vec_id", series.profile_metrics("s", F.lit(0.64)).alias("m")).select("vec_id", "m.*")
    return d.select("vec_id", *[num(c, c) for c in d.columns if c != "vec_id"])


@query(
    "i24_failed_tiles",
    with_(
        ser=SER.replace("* 4e0", "* 4e0 - 0.8e0"), l=LAGS,
        then="SELECT vec_id FROM ser GROUP BY 1 HAVING vec_id NOT IN (SELECT vec_id FROM l WHERE s > 0 AND s > p AND s > n)",
    ),
)
def i24(spark, sf):
    d = profiles(spark, sf, 0.8).select("vec_id", series.profile_metrics("s", F.lit(0.64)).alias("m")).select("vec_id", "m.*")
    return raster.failed_tiles(d).select("vec_id")


# --- ingest and masks ------------------------------------------------------------------------------


@query("s11_raster_rows", with_("px", then=f"SELECT image_id, {b('count(DISTINCT y)')} AS h, {b('count(DISTINCT x)')} AS w, {r('sum(v)', 3)} AS total FROM px GROUP BY 1"))
def s11(spark, sf):
    d = strips(spark, sf)
    total = rasters.long_view(d).groupBy("image_id").agg(num(F.sum("v"), "total", 3))
    return rasters.image_sizes(d).join(total, "image_id").select("image_id", big("h", "h"), big("w", "w"), "total")


@query(
    "s12_binarise",
    with_("px", then=f"SELECT image_id, y, {b('count_if(v > 128)')} AS above, {b('count_if(v = 127)')} AS equal FROM px GROUP BY 1, 2"),
)
def s12(spark, sf):
    d = strips(spark, sf)
    above = rasters.binarise(d, "pixels", threshold=128.0).select("image_id", "y", F.col("pixels").alias("above"))
    equal = rasters.binarise(d, "pixels", equals=127.0).select("image_id", "y", F.col("pixels").alias("equal"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v).cast("bigint")
    return above.join(equal, ["image_id", "y"]).select("image_id", "y", total("above").alias("above"), total("equal").alias("equal"))


@query(
    "s14_all_key_combinations",
    with_("px", then=f"SELECT image_id, patch, m, {b('count(*)')} AS n, {r('avg(v)')} AS mean FROM px GROUP BY ALL"),
)
def s14(spark, sf):
    return pixels(spark, sf).groupBy("image_id", "patch", "m").agg(big(F.count("*"), "n"), num(F.avg("v"), "mean"))


@query(
    "i25_pixel_size",
    with_(
        "px", i="SELECT DISTINCT image_id FROM px",
        then=f"SELECT image_id, {r('(640221e0 + image_id) / 1000000e0', 8)} AS um_per_px, abs((640221e0 + image_id) / 1000000e0 - 640222e0 / 1000000e0) > 1e-6 AS mismatch FROM i",
    ),
)
def i25(spark, sf):
    i = strips(spark, sf).select("image_id").distinct()
    d = i.select("image_id", (F.col("image_id") + 640221.0).alias("x_num"), F.lit(1e6).alias("x_den"), F.lit(640222.0).alias("y_num"), F.lit(1e6).alias("y_den"))
    return rasters.pixel_sizes(d).select("image_id", num("um_per_px", "um_per_px", 8), F.col("resolution_mismatch").alias("mismatch"))


# --- tiles -----------------------------------------------------------------------------------------

SIZES = "SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY 1"
TILES = "SELECT image_id, tx, ty FROM sz, range(0, 49, 4) a(tx), range(0, 49, 4) c(ty) WHERE tx + 16 <= w AND ty + 16 <= h"


@query("i1_enumerate_tiles", with_("px", sz=SIZES, t=TILES, then=f"SELECT image_id, {b('tx')} AS tx, {b('ty')} AS ty FROM t"))
def i1(spark, sf):
    return raster.enumerate_tiles(rasters.image_sizes(strips(spark, sf)), 16, 4)


COVERAGE = "SELECT t.image_id, t.tx, t.ty, sum(CASE WHEN m THEN 1e0 ELSE 0 END) / 256 AS c FROM t JOIN px ON px.image_id = t.image_id AND y >= ty AND y < ty + 16 AND x >= tx AND x < tx + 16 GROUP BY ALL"


@query("i2_tile_coverage", with_("px", sz=SIZES, t=TILES, cv=COVERAGE, then=f"SELECT image_id, {b('tx')} AS tx, {b('ty')} AS ty, {r('c')} AS coverage FROM cv WHERE c >= 0.5"))
def i2(spark, sf):
    return raster.covered_tiles(strips(spark, sf), 16, 4, 0.5).select("image_id", "tx", "ty", num("coverage", "coverage"))


@query(
    "p17_centre_microns",
    with_("px", sz=SIZES, t=TILES, then=f"SELECT image_id, {b('tx')} AS tx, {b('ty')} AS ty, {r('(tx + 8) * 0.64e0')} AS cx, {r('(ty + 8) * 0.64e0')} AS cy FROM t"),
)
def p17(spark, sf):
    t = raster.enumerate_tiles(rasters.image_sizes(strips(spark, sf)), 16, 4)
    return raster.tile_centres(t, 16, F.lit(0.64)).select("image_id", "tx", "ty", num("centre_x_um", "cx"), num("centre_y_um", "cy"))


def block_tiles(spark, sf, p):
    d = strips(spark, sf)
    return tiles.tile_maps(d, raster.covered_tiles(d, p.roi, p.stride, 0.0), p)


PLAIN = tiles.TileParams(roi=16, stride=16, background_radius=None, sigma_small=None, pad_factor=1.0, finite_size="as_written", r_min=2.0)
SMALL = tiles.TileParams(roi=16, stride=8, background_radius=3, sigma_small=1.0, sigma_large=4.0, r_min=2.0)

ACF = {
    "sz": SIZES,
    "t": "SELECT image_id, tx, ty FROM sz, range(0, 49, 16) a(tx), range(0, 49, 16) c(ty) WHERE tx + 16 <= w AND ty + 16 <= h",
    "tp": "SELECT t.image_id, tx, ty, y - ty AS y, x - tx AS x, v - avg(v) OVER (PARTITION BY t.image_id, tx, ty) AS v FROM t JOIN px ON px.image_id = t.image_id AND y >= ty AND y < ty + 16 AND x >= tx AND x < tx + 16",
    "ac": "SELECT a.image_id, a.tx, a.ty, (e.y - a.y + 24) % 16 - 8 AS dy, (e.x - a.x + 24) % 16 - 8 AS dx, sum(a.v * e.v) AS s FROM tp a JOIN tp e ON a.image_id = e.image_id AND a.tx = e.tx AND a.ty = e.ty GROUP BY ALL",
    "nm": "SELECT *, s / max(CASE WHEN dy = 0 AND dx = 0 THEN s END) OVER (PARTITION BY image_id, tx, ty) AS c FROM ac",
}


@query(
    "i7_autocorrelation",
    with_(
        "px", **ACF,
        then=f"SELECT image_id, {b('tx')} AS tx, {b('ty')} AS ty, {b('floor(sqrt(dy * dy + dx * dx))')} AS radius, {r('avg(c)', 5)} AS mean FROM nm"
        " WHERE floor(sqrt(dy * dy + dx * dx)) <= 8 GROUP BY 1, 2, 3, 4",
    ),
)
def i7(spark, sf):
    d = block_tiles(spark, sf, PLAIN).select("image_id", "tx", "ty", F.posexplode("profile").alias("radius", "mean"))
    return d.select("image_id", "tx", "ty", big("radius", "radius"), num("mean", "mean", 5))


@query(
    "i3_tile_extraction",
    with_(
        "px", sz=SIZES, t=TILES.replace("49, 4", "49, 8"),
        s="SELECT t.image_id, t.tx, t.ty, sum(v) AS s, sum(v * (y - t.ty + 1) * (x - t.tx + 1)) AS wsum FROM t JOIN px ON px.image_id = t.image_id AND y >= ty AND y < ty + 16 AND x >= tx AND x < tx + 16 GROUP BY ALL",
        then=f"SELECT image_id, {b('tx')} AS tx, {b('ty')} AS ty, {r('s', 3)} AS total, {r('wsum', 3)} AS weighted FROM s",
    ),
)
def i3(spark, sf):
    """Tiles cut from their halo blocks, checked by a plain and a position-weighted sum."""
    d, p = strips(spark, sf), SMALL
    t = raster.enumerate_tiles(rasters.image_sizes(d), p.roi, p.stride)
    placed = t.withColumns({"by": F.floor(F.col("ty") / p.block).cast("int"), "bx": F.floor(F.col("tx") / p.block).cast("int")})
    rows = tiles.block_strips(d, p).join(placed, ["image_id", "by", "bx"]).filter("y >= ty AND y < ty + 16")
    cut = F.slice("segment", F.col("tx").cast("int") - F.col("bx") * p.block + 1, p.roi)
    plain = F.aggregate(cut, F.lit(0.0), lambda s, v: s + v)
    weighted = F.aggregate(F.transform(cut, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v) * (F.col("y") - F.col("ty") + 1)
    return rows.groupBy("image_id", "tx", "ty").agg(num(F.sum(plain), "total", 3), num(F.sum(weighted), "weighted", 3))


@query("i4_i5_i6_filtered_tiles")
def i456(spark, sf):
    """Top-hat, difference of Gaussians and padding ahead of the autocorrelation."""
    d = block_tiles(spark, sf, SMALL)
    return d.select("image_id", "tx", "ty", F.size("profile").alias("bins"), num(F.get("profile", F.lit(0)), "centre"), num("trough_value", "trough"))


@query("i8_tile_metrics")
def i8(spark, sf):
    m = tiles.tile_metrics(block_tiles(spark, sf, SMALL), F.lit(0.64), "local_max", SMALL)
    return m.select("image_id", "tx", "ty", *[num(c, c) for c in m.columns[3:]])


@query("i8_tile_line_metrics")
def i8_line(spark, sf):
    m = tiles.tile_metrics(block_tiles(spark, sf, SMALL), F.lit(0.64), "line", SMALL)
    return m.select("image_id", "tx", "ty", *[num(c, c) for c in m.columns[3:]])


@query(
    "i7_lag_products",
    with_(
        "px",
        tp="SELECT image_id, floor(y / 8e0) AS byy, floor(x / 8e0) AS bxx, y % 8 AS y, x % 8 AS x, v FROM px",
        whole="SELECT image_id, byy, bxx FROM tp GROUP BY 1, 2, 3 HAVING count(*) = 64",
        then=f"SELECT a.image_id, {b('a.byy')} AS byy, {b('a.bxx')} AS bxx, {b('(e.y - a.y + 8) % 8')} AS dy, {b('(e.x - a.x + 8) % 8')} AS dx, {r('sum(a.v * e.v)', 2)} AS value"
        " FROM tp a JOIN tp e USING (image_id, byy, bxx) JOIN whole USING (image_id, byy, bxx) GROUP BY 1, 2, 3, 4, 5",
    ),
)
def i7_pairs(spark, sf):
    d = pixels(spark, sf).select(
        "image_id", F.floor(F.col("y") / 8).alias("byy"), F.floor(F.col("x") / 8).alias("bxx"), (F.col("y") % 8).alias("y"), (F.col("x") % 8).alias("x"), "v"
    )
    out = raster.lag_products(d, ["image_id", "byy", "bxx"], 8, 8)
    return out.select("image_id", "byy", "bxx", big("dy", "dy"), big("dx", "dx"), num("value", "value", 2))


# --- autocorrelation map geometry: each image taken as a map centred at (32, 32) -------------------

CENTRED = "SELECT image_id, y, x, v - 128 AS v FROM px"


def centred(spark, sf):
    return pixels(spark, sf).withColumn("v", F.col("v") - 128)


def centred_strips(spark, sf):
    return strips(spark, sf).withColumn("pixels", F.transform("pixels", lambda v: v - 128))


@query(
    "i9_radial_mean",
    with_("px", c=CENTRED, then=f"SELECT image_id, {b('floor(sqrt(pow(x - 32, 2) + pow(y - 32, 2)))')} AS radius, {r('avg(v)')} AS mean FROM c GROUP BY 1, 2"),
)
def i9(spark, sf):
    return raster.radial_mean(centred(spark, sf), ["image_id"], F.lit(32), F.lit(32)).select("image_id", "radius", num("mean", "mean"))


TROUGH = (
    "SELECT image_id, min(v) AS v, arg_min(y, struct_pack(v := v, y := y, x := x)) AS ty, arg_min(x, struct_pack(v := v, y := y, x := x)) AS tx"
    " FROM c WHERE sqrt(pow(x - 32, 2) + pow(y - 32, 2)) > 5 AND sqrt(pow(x - 32, 2) + pow(y - 32, 2)) <= 30 AND v < 0 GROUP BY 1"
)


def troughs(spark, sf):
    return raster.locate_trough(centred(spark, sf), ["image_id"], F.lit(32), F.lit(32), 5.0, F.lit(30.0))


@query(
    "i10_trough_location",
    with_("px", c=CENTRED, t=TROUGH, then=f"SELECT image_id, {r('v')} AS trough_value, ty AS trough_y, tx AS trough_x, {r('sqrt(pow(ty - 32, 2) + pow(tx - 32, 2))')} AS trough_radius FROM t"),
)
def i10(spark, sf):
    return troughs(spark, sf).select("image_id", num("trough_value", "trough_value"), "trough_y", "trough_x", num("trough_radius", "trough_radius"))


@query(
    "i11_orientation",
    with_(
        "px", c=CENTRED, t=TROUGH,
        a="SELECT image_id, atan2(ty - 32, tx - 32) AS a FROM t",
        then=f"SELECT image_id, {r('a')} AS rad, {r('degrees(a)')} AS deg, {r('fmod(degrees(a) + 360, 180)')} AS deg_180 FROM a",
    ),
)
def i11(spark, sf):
    d = troughs(spark, sf)
    return d.select("image_id", num("orientation_min_radians", "rad"), num("orientation_min_degrees", "deg"), num("orientation_min_degrees_180", "deg_180"))


def sample_sql(points: str, border: str) -> dict[str, str]:
    """CTEs that sample image c at points (image_id, k, sx, sy), written pixel by pixel."""
    if border == "reflect":
        fold = lambda i, n: f"CASE WHEN {i} < 0 THEN -1 - {i} WHEN {i} >= {n} THEN 2 * {n} - 1 - {i} ELSE {i} END"
        sizes = "JOIN (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM c GROUP BY 1) USING (image_id)"
    else:
        fold, sizes = (lambda i, n: i), ", (SELECT 0 AS h, 0 AS w)"
    return {
        "pts": points,
        "nb": f"SELECT image_id, k, {fold('(floor(sy) + oy)', 'h')} AS y, {fold('(floor(sx) + ox)', 'w')} AS x,"
        " (CASE WHEN oy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN ox = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS wt"
        f" FROM pts {sizes}, range(0, 2) a(oy), range(0, 2) e(ox)",
        "smp": "SELECT nb.image_id, nb.k, sum(nb.wt * coalesce(c.v, 0)) AS v FROM nb LEFT JOIN c ON c.image_id = nb.image_id AND c.y = nb.y AND c.x = nb.x GROUP BY 1, 2",
    }


CIRCLE = (
    f"SELECT image_id, k, 32 + sqrt(pow(ty - 32, 2) + pow(tx - 32, 2)) * cos(k * (2 * {PI} / 360)) AS sx,"
    f" 32 + sqrt(pow(ty - 32, 2) + pow(tx - 32, 2)) * sin(k * (2 * {PI} / 360)) AS sy FROM t, range(0, 360) q(k)"
)


@query(
    "i12_circle_sampling",
    with_("px", c=CENTRED, t=TROUGH, **sample_sql(CIRCLE, "reflect"), then=f"SELECT image_id, {b('k')} AS k, {r('v', 5)} AS v FROM smp"),
)
def i12(spark, sf):
    t = troughs(spark, sf).withColumns({"cy": F.lit(32.0), "cx": F.lit(32.0)}).select("image_id", "cy", "cx", "trough_radius")
    d = raster.bilinear_sample(centred_strips(spark, sf), raster.circle_points(t, "trough_radius"), "reflect")
    return d.select("image_id", big("k", "k"), num("v", "v", 5))


@query(
    "i12_circle_maximum",
    with_(
        "px", c=CENTRED, t=TROUGH, **sample_sql(CIRCLE, "reflect"),
        bst="SELECT image_id, max(v) AS v, arg_max(k, struct_pack(v := v, k := -k)) AS k FROM smp GROUP BY 1",
        then=f"SELECT image_id, {r('v', 5)} AS circle_max, {r('k')} AS deg FROM bst",
    ),
)
def i12_max(spark, sf):
    t = troughs(spark, sf).withColumns({"cy": F.lit(32.0), "cx": F.lit(32.0)}).select("image_id", "cy", "cx", "trough_radius")
    d = raster.bilinear_sample(centred_strips(spark, sf), raster.circle_points(t, "trough_radius"), "reflect")
    best = raster.circle_maximum(d, ["image_id"])
    return best.select("image_id", num("circle_max", "circle_max", 5), num("orientation_max_degrees", "deg"))


LINE = "SELECT image_id, k, 32 + k * cos(atan2(ty - 32, tx - 32)) AS sx, 32 + k * sin(atan2(ty - 32, tx - 32)) AS sy FROM t, range(0, 46) q(k)"


@query(
    "i13_line_profile",
    with_("px", c=CENTRED, t=TROUGH, **sample_sql(LINE, "constant"), then=f"SELECT image_id, {b('k')} AS k, {r('v', 5)} AS v FROM smp"),
)
def i13(spark, sf):
    t = troughs(spark, sf).withColumns({"cy": F.lit(32.0), "cx": F.lit(32.0)}).select("image_id", "cy", "cx", "orientation_min_radians")
    d = raster.bilinear_sample(centred_strips(spark, sf), raster.line_points(t, F.lit(45.0), "orientation_min_radians"), "constant")
    return d.select("image_id", big("k", "k"), num("v", "v", 5))


# --- registration ----------------------------------------------------------------------------------

MOMENTS = {
    "mo": "SELECT image_id, count(*) AS area, avg(y) AS cy, avg(x) AS cx, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS cov FROM px WHERE m GROUP BY 1",
    "el": f"SELECT image_id, area, cy, cx, {PI} / 2 - 0.5e0 * atan2(2 * cov, vy - vx) AS ori,"
    " 4 * sqrt((vx + vy) / 2 + sqrt(pow(vx - vy, 2) / 4 + cov * cov)) AS major, 4 * sqrt((vx + vy) / 2 - sqrt(pow(vx - vy, 2) / 4 + cov * cov)) AS minor FROM mo",
}


def moments(spark, sf):
    return raster.mask_moments(pixels(spark, sf).filter("m"), ["image_id"])


@query(
    "i15_mask_moments",
    with_("px", **MOMENTS, then=f"SELECT image_id, {b('area')} AS area, {r('cy')} AS cy, {r('cx')} AS cx, {r('ori')} AS orientation, {r('major')} AS major, {r('minor')} AS minor FROM el"),
)
def i15(spark, sf):
    d = moments(spark, sf)
    return d.select("image_id", "area", *[num(c, c) for c in ("cy", "cx", "orientation", "major", "minor")])


CANVAS = "SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w, CAST(floor(1.5e0 * (max(y) + 1)) AS BIGINT) AS ch, CAST(floor(1.5e0 * (max(x) + 1)) AS BIGINT) AS cw FROM px GROUP BY 1"


@query("i17_canvas", with_("px", cn=CANVAS, then=f"SELECT image_id, ch AS canvas_h, cw AS canvas_w, {r('(ch - h) / 2e0')} AS offset_y, {r('(cw - w) / 2e0')} AS offset_x FROM cn"))
def i17(spark, sf):
    d = raster.canvas(rasters.image_sizes(strips(spark, sf)))
    return d.select("image_id", big("canvas_h", "canvas_h"), big("canvas_w", "canvas_w"), num("offset_y", "offset_y"), num("offset_x", "offset_x"))


AFFINE = {
    "cn": CANVAS,
    # every image is registered to the ellipse of the next one (the last to that of the first), on its own canvas
    "pr": "SELECT s.image_id, s.cx AS scx, s.cy AS scy, s.ori AS so, s.major AS sa, s.minor AS si, t.cx + (cw - w) / 2e0 AS tcx, t.cy + (ch - h) / 2e0 AS tcy, t.ori AS tori, t.major AS ta, t.minor AS ti, ch, cw"
    " FROM el s JOIN el t ON t.image_id = (s.image_id + 1) % (SELECT max(image_id) + 1 FROM el) JOIN cn ON cn.image_id = s.image_id",
    "mt": "SELECT *, cos(tori) * (ta / sa) * cos(-so) - sin(tori) * (ti / si) * sin(-so) AS a, -cos(tori) * (ta / sa) * sin(-so) - sin(tori) * (ti / si) * cos(-so) AS b,"
    " sin(tori) * (ta / sa) * cos(-so) + cos(tori) * (ti / si) * sin(-so) AS c, -sin(tori) * (ta / sa) * sin(-so) + cos(tori) * (ti / si) * cos(-so) AS d FROM pr",
    "af": "SELECT image_id, ch, cw, tcx, tcy, a AS m00, b AS m01, tcx - a * scx - b * scy AS m02, c AS m10, d AS m11, tcy - c * scx - d * scy AS m12 FROM mt",
}


def affine(spark, sf):
    e = moments(spark, sf).drop("area")
    c = raster.canvas(rasters.image_sizes(strips(spark, sf)))
    names = ("cx", "cy", "orientation", "major", "minor")
    s = e.select("image_id", *[F.col(n).alias(f"s_{n}") for n in names])
    # a row per image: every one is registered to the next, the last to the first; ids may have gaps
    ordered = Window.orderBy("image_id")
    own = F.struct(*names)
    t = e.select("image_id", F.coalesce(F.lead(own).over(ordered), F.first(own).over(ordered)).alias("t")).select("image_id", *[F.col(f"t.{n}").alias(f"t_{n}") for n in names])
    p = s.join(t, "image_id").join(c, "image_id")
    p = p.withColumns({"t_cx": F.col("t_cx") + F.col("offset_x"), "t_cy": F.col("t_cy") + F.col("offset_y")})
    out = raster.ellipse_affine(p)
    return out.withColumns({"out_h": F.col("canvas_h"), "out_w": F.col("canvas_w")})


MATRIX = ("m00", "m01", "m02", "m10", "m11", "m12")


@query("i16_ellipse_affine", with_("px", **MOMENTS, **AFFINE, then="SELECT image_id, " + ", ".join(f"{r(m)} AS {m}" for m in MATRIX) + " FROM af"))
def i16(spark, sf):
    return affine(spark, sf).select("image_id", *[num(m, m) for m in MATRIX])


GRID = (
    "SELECT image_id, gy * 100000 + gx AS k, (m11 * (gx - m02) - m01 * (gy - m12)) / (m00 * m11 - m01 * m10) AS sx,"
    " (m00 * (gy - m12) - m10 * (gx - m02)) / (m00 * m11 - m01 * m10) AS sy FROM af, range(0, 1000) a(gy), range(0, 1000) e(gx) WHERE gy < ch AND gx < cw"
)


def mask_strips(spark, sf):
    return strips(spark, sf).select("image_id", "y", F.col("mask").alias("pixels"))


@query(
    "i18_warp",
    with_(
        "px", **MOMENTS, **AFFINE, c="SELECT image_id, y, x, CASE WHEN m THEN 1e0 ELSE 0e0 END AS v FROM px",
        **sample_sql(GRID, "constant"),
        then=f"SELECT image_id, {b('floor(k / 100000e0)')} AS y, {b('k % 100000')} AS x, {r('v', 5)} AS v, v > 0.5 AS inside FROM smp WHERE v > 1e-9",
    ),
)
def i18(spark, sf):
    w = raster.warp(mask_strips(spark, sf), affine(spark, sf))
    return w.filter("v > 1e-9").select("image_id", "y", "x", num("v", "v", 5), (F.col("v") > 0.5).alias("inside"))


@query(
    "i19_residual_shift",
    with_(
        "px", **MOMENTS, **AFFINE, c="SELECT image_id, y, x, CASE WHEN m THEN 1e0 ELSE 0e0 END AS v FROM px",
        **sample_sql(GRID, "constant"),
        wm="SELECT image_id, avg(floor(k / 100000e0)) AS cy, avg(k % 100000) AS cx FROM smp WHERE v > 0.5 GROUP BY 1",
        then=f"SELECT image_id, {r('tcx - cx', 5)} AS delta_x, {r('tcy - cy', 5)} AS delta_y FROM wm JOIN af USING (image_id)",
    ),
)
def i19(spark, sf):
    from axonframe.plans.tilemap import residual_shift

    d = residual_shift(mask_strips(spark, sf), affine(spark, sf))
    return d.select("image_id", num("delta_x", "delta_x", 5), num("delta_y", "delta_y", 5))


@query("i19_registered_image")
def i19_registered(spark, sf):
    """Both warps and the crop, on the grey image and its mask."""
    from axonframe.plans.tilemap import register

    out = register(strips(spark, sf).select("image_id", "y", "pixels"), mask_strips(spark, sf), affine(spark, sf))
    return out.groupBy("image_id").agg(big(F.count("*"), "pixels"), big(F.count_if("inside"), "area"), num(F.avg("v"), "mean"))


# --- masks -----------------------------------------------------------------------------------------

SPARSE = "SELECT image_id, y, x FROM px WHERE v > 144"


def sparse_masks(spark, sf):
    return strips(spark, sf).select("image_id", "y", F.transform("pixels", lambda v: F.when(v > 144, 1.0).otherwise(0.0)).alias("mask"))


@query(
    "i20_largest_component",
    "WITH RECURSIVE "
    + with_("px", s=SPARSE, then="")[5:].rstrip()
    + ", reach AS (SELECT image_id, y, x, y AS ry, x AS rx FROM s UNION SELECT s.image_id, s.y, s.x, q.ry, q.rx FROM reach q JOIN s ON s.image_id = q.image_id"
    " AND abs(s.y - q.y) <= 1 AND abs(s.x - q.x) <= 1),"
    " root AS (SELECT image_id, y, x, min(ry * 100000 + rx) AS comp FROM reach GROUP BY 1, 2, 3),"
    " bx AS (SELECT image_id, comp, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, count(*) AS area FROM root GROUP BY 1, 2)"
    f" SELECT image_id, {b('y0')} AS min_row, {b('x0')} AS min_col, {b('y1')} AS max_row, {b('x1')} AS max_col, {b('area')} AS area FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, comp) AS rn FROM bx) WHERE rn = 1",
)
def i20(spark, sf):
    d = components.largest_component(sparse_masks(spark, sf))
    return d.select("image_id", *[big(c, c) for c in ("min_row", "min_col", "max_row", "max_col", "area")])


@query(
    "i21_centred_roi",
    with_(
        "px", sz=SIZES,
        bx="SELECT image_id, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM px WHERE v > 170 GROUP BY 1",
        then=f"SELECT image_id, {b('greatest(0, least((y0 + y1) // 2 - 8, h - 16))')} AS roi_y0, {b('greatest(0, least((x0 + x1) // 2 - 8, w - 16))')} AS roi_x0 FROM bx JOIN sz USING (image_id)",
    ),
)
def i21(spark, sf):
    from axonframe.operators.summarise import extent

    boxes = extent(pixels(spark, sf).filter("v > 170"), ["image_id"]).join(rasters.image_sizes(strips(spark, sf)), "image_id")
    return raster.centred_roi(boxes, 16).select("image_id", big("roi_y0", "roi_y0"), big("roi_x0", "roi_x0"))


@query(
    "i22_mask_outline",
    with_(
        "px", s="SELECT image_id, y, x FROM px WHERE m",
        n="SELECT a.image_id, a.y, a.x, count(e.y) AS n FROM s a LEFT JOIN s e ON a.image_id = e.image_id AND abs(a.y - e.y) + abs(a.x - e.x) = 1 GROUP BY 1, 2, 3",
        then="SELECT image_id, y, x FROM n WHERE n < 4",
    ),
)
def i22(spark, sf):
    return raster.outline(strips(spark, sf).select("image_id", "y", "mask"))


@query(
    "i23_metric_grid",
    with_(
        "px", sz=SIZES, t=TILES, cv=COVERAGE,
        p="SELECT image_id, (tx + 8) * 0.64e0 AS px, (ty + 8) * 0.64e0 AS py, c FROM cv",
        g="SELECT *, min(px) OVER w AS x0, max(px) OVER w AS x1, min(py) OVER w AS y0, max(py) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY image_id)",
        then=f"SELECT image_id, {b('floor((py - y0) / (y1 - y0) * 7 + 0.5)')} AS gy, {b('floor((px - x0) / (x1 - x0) * 7 + 0.5)')} AS gx, {r('avg(c)')} AS mean FROM g GROUP BY 1, 2, 3",
    ),
)
def i23(spark, sf):
    t = raster.tile_centres(raster.tile_coverage(strips(spark, sf), 16, 4), 16, F.lit(0.64))
    d = raster.metric_grid(t.withColumnsRenamed({"centre_x_um": "px", "centre_y_um": "py"}), ["image_id"], "coverage", cells=8)
    return d.select("image_id", big("gy", "gy"), big("gx", "gx"), num("mean", "mean"))


@query(
    "i23_metric_grid_spread",
    with_(
        "px", sz=SIZES, t=TILES, cv=COVERAGE,
        p="SELECT image_id, (tx + 8) * 0.64e0 AS px, (ty + 8) * 0.64e0 AS py, c FROM cv",
        e="SELECT *, min(px) OVER w AS x0, max(px) OVER w AS x1, min(py) OVER w AS y0, max(py) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY image_id)",
        g="SELECT image_id, floor((py - y0) / (y1 - y0) * 12 + 0.5)::INT AS cy, floor((px - x0) / (x1 - x0) * 12 + 0.5)::INT AS cx, avg(c) AS m FROM e GROUP BY 1, 2, 3",
        o="SELECT dy, dx, CASE WHEN dy = 0 AND dx = 0 THEN 1e12 ELSE 1e0 / (dy * dy + dx * dx) END AS wt FROM range(-1, 2) a(dy), range(-1, 2) e(dx)",
        s="SELECT image_id, cy + dy AS gy, cx + dx AS gx, wt, m FROM g, o WHERE cy + dy BETWEEN 0 AND 12 AND cx + dx BETWEEN 0 AND 12",
        then=f"SELECT image_id, {b('gy')} AS gy, {b('gx')} AS gx, {r('sum(wt * m) / sum(wt)')} AS mean FROM s GROUP BY 1, 2, 3",
    ),
)
def i23_spread(spark, sf):
    d = strips(spark, sf)
    t = raster.tile_centres(raster.tile_coverage(d, 16, 4), 16, F.lit(0.64))
    out = raster.metric_grid(t.withColumnsRenamed({"centre_x_um": "px", "centre_y_um": "py"}), ["image_id"], "coverage", cells=13, reach=1)
    return out.select("image_id", big("gy", "gy"), big("gx", "gx"), num("mean", "mean"))


# --- permutation tests -----------------------------------------------------------------------------

KEYED = "('0x' || substr(md5(concat_ws('-', 's', CAST(it AS VARCHAR), {id})), 1, 15))::BIGINT"


@query(
    "t20_keyed_permutation",
    with_(
        "px",
        k="SELECT image_id, it, v, " + KEYED.format(id="CAST(image_id AS VARCHAR), CAST(y AS VARCHAR), CAST(x AS VARCHAR)") + " AS h, count_if(patch) OVER (PARTITION BY image_id, it) AS np FROM px, range(0, 3) i(it)",
        o="SELECT *, row_number() OVER (PARTITION BY image_id, it ORDER BY h) AS rn FROM k",
        then=f"SELECT image_id, {b('it')} AS iter, {r('avg(v) FILTER (rn <= np) / avg(v) FILTER (rn > np)', 8)} AS ratio FROM o GROUP BY 1, 2",
    ),
)
def t20_keyed(spark, sf):
    from axonframe.operators.attach import attach

    px = pixels(spark, sf)
    d = attach(px, px.groupBy("image_id").agg(F.count_if("patch").alias("np")), ["image_id"])
    out = permute.keyed_permutations(d, ["image_id"], "v", F.concat_ws("-", "image_id", "y", "x"), "np", 3)
    return out.select("image_id", big("iter", "iter"), num("ratio", "ratio", 8))


@query(
    "t20_null_moments",
    with_(
        "px",
        s="SELECT image_id, avg(v) AS mu, var_pop(v) AS va, count(*) AS n, count_if(patch AND m) AS k FROM px GROUP BY 1",
        then=f"SELECT image_id, {r('mu')} AS null_mean, {r('va / k * (n - k) / (n - 1)', 8)} AS null_variance FROM s",
    ),
)
def t20_null(spark, sf):
    d = permute.null_moments(pixels(spark, sf), ["image_id"], "v", F.col("patch") & F.col("m"))
    return d.select("image_id", num("null_mean", "null_mean"), num("null_variance", "null_variance", 8))


# The bounds of a permutation test are quantiles of a ratio whose logarithm is nearly normal with a known spread. A
# quantile of n draws has a standard error of sqrt(q (1 - q) / n) / density; bounds must lie within five of them
# (and the normal form's own error of a few thousandths of the spread).
QUANTILE_Z, QUANTILE_ERROR = 1.959963984540054, math.sqrt(0.025 * 0.975) / 0.05844507
NULL_SQL = (
    "SELECT {by}, sqrt(va / (mu * mu) * ((n - k) / k + (n - l) / l + 2) / (n - 1)) AS null_sd, mp / mi AS ratio FROM ("
    "SELECT {by}, avg(v) AS mu, var_pop(v) AS va, count(*)::DOUBLE AS n, (count(*) FILTER ({a}))::DOUBLE AS k, (count(*) FILTER ({b}))::DOUBLE AS l,"
    " avg(v) FILTER ({a}) AS mp, avg(v) FILTER ({b}) AS mi FROM {t} GROUP BY 1)"
)


def bounds_sql(by: str, n_iter: int) -> str:
    return f"SELECT {by}, {r('ratio')} AS ratio, {r('null_sd')} AS null_sd, TRUE AS low_fits, TRUE AS high_fits, TRUE AS p_fits, {b(str(n_iter))} AS n_shuffles FROM nl"


def bounds_fit(test, levels, by, n_iter):
    """The result of a test beside the closed form of its null distribution."""
    from axonframe.functions import dist

    room = F.col("null_sd") * (5 * QUANTILE_ERROR / math.sqrt(n_iter) + 0.01)
    near = lambda c, z: F.abs(F.log(c) - z * F.col("null_sd")) < room
    d = test.join(permute.null_ratio(levels, [by]), by)
    p = dist.normal_p_value(F.abs(F.log("ratio")) / F.col("null_sd"))
    return d.select(
        by, num("ratio", "ratio"), num("null_sd", "null_sd"), near("low", -QUANTILE_Z).alias("low_fits"), near("high", QUANTILE_Z).alias("high_fits"),
        (F.abs(F.col("p_empirical") - p) < 5 * F.sqrt((p * (1 - p) + 1 / n_iter) / n_iter) + 0.02).alias("p_fits"), big("n_shuffles", "n_shuffles"),
    )


def mask_levels(d, by, a, b):
    return d.groupBy(by, F.col("v").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("n_patch"), F.count_if(b).alias("n_inter"))


@query("t20_permutation_test", with_("px", nl=NULL_SQL.format(by="image_id", a="patch AND m", b="NOT patch AND m", t="px"), then=bounds_sql("image_id", 10_000)))
def t20(spark, sf):
    px = pixels(spark, sf)
    a, b_ = F.col("patch") & F.col("m"), ~F.col("patch") & F.col("m")
    d = permute.permutation_test(px, ["image_id"], "v", a, b_, n_iter=10_000)
    return bounds_fit(d, mask_levels(px, "image_id", a, b_), "image_id", 10_000)


def pooled(spark, sf):
    """Masked pixels, each image divided by its patch mean, pooled over four images."""
    from axonframe.operators.summarise import normalise_by_mean

    d = pixels(spark, sf).filter("m")
    d = normalise_by_mean(d, ["image_id"], "v", F.col("patch"))
    return d.withColumn("region", F.floor(F.col("image_id") / 4))


POOLED = {
    "pm": "SELECT image_id, avg(v) AS pm FROM px WHERE m AND patch GROUP BY 1",
    "pl": "SELECT CAST(floor(image_id / 4e0) AS BIGINT) AS region, image_id, y, x, patch, CASE WHEN pm > 0 THEN v / pm ELSE v END AS v FROM px LEFT JOIN pm USING (image_id) WHERE m",
}


@query(
    "t21_keyed_permutation",
    with_(
        "px", **POOLED,
        k="SELECT region, it, v, " + KEYED.format(id="CAST(image_id AS VARCHAR), CAST(y AS VARCHAR), CAST(x AS VARCHAR)") + " AS h, count_if(patch) OVER (PARTITION BY region, it) AS np FROM pl, range(0, 3) i(it)",
        o="SELECT *, row_number() OVER (PARTITION BY region, it ORDER BY h) AS rn FROM k",
        then=f"SELECT region, {b('it')} AS iter, {r('avg(v) FILTER (rn <= np) / avg(v) FILTER (rn > np)', 8)} AS ratio FROM o GROUP BY 1, 2",
    ),
)
def t21_keyed(spark, sf):
    from axonframe.operators.attach import attach

    px = pooled(spark, sf)
    d = attach(px, px.groupBy("region").agg(F.count_if("patch").alias("np")), ["region"])
    out = permute.keyed_permutations(d, ["region"], "v", F.concat_ws("-", "image_id", "y", "x"), "np", 3)
    return out.select("region", big("iter", "iter"), num("ratio", "ratio", 8))


@query("t21_pooled_permutation_test", with_("px", **POOLED, nl=NULL_SQL.format(by="region", a="patch", b="NOT patch", t="pl"), then=bounds_sql("region", 50_000)))
def t21(spark, sf):
    px = pooled(spark, sf)
    d = permute.permutation_test(px, ["region"], "v", F.col("patch"), ~F.col("patch"), n_iter=50_000, population="masks")
    return bounds_fit(d, mask_levels(px, "region", F.col("patch"), ~F.col("patch")), "region", 50_000)


@query(
    "t21_observed_ratio",
    with_("px", **POOLED, then=f"SELECT region, {b('count_if(patch)')} AS n_patch, {b('count_if(NOT patch)')} AS n_interpatch, {r('avg(v) FILTER (patch) / avg(v) FILTER (NOT patch)')} AS ratio FROM pl GROUP BY 1"),
)
def t21_observed(spark, sf):
    from axonframe.operators.summarise import masked_ratio

    d = masked_ratio(pooled(spark, sf), ["region"], "v", F.col("patch"), ~F.col("patch"))
    return d.select("region", big("n_patch", "n_patch"), big("n_interpatch", "n_interpatch"), num("ratio", "ratio"))
