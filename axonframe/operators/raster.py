"""Image operators on strip and pixel tables.

Pixels are never replicated per tile: sums over sliding windows come from cumulative sums, and
neighbourhood values are built from row strips, so that a sample point needs one equi-join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.functions.scalar import ColumnLike, col, ratio
from axonframe.operators.attach import attach
from axonframe.sources.rasters import image_sizes

# --- tiles -----------------------------------------------------------------------------------------


def enumerate_tiles(images: DataFrame, roi: int, stride: int) -> DataFrame:
    """(image_id, tx, ty) of all windows that fit into the image; ``images`` has h and w."""

    def starts(size: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(size) - roi, F.lit(stride).cast("bigint")))

    fits = images.filter((F.col("h") >= roi) & (F.col("w") >= roi))
    return fits.withColumn("tx", starts("w")).withColumn("ty", starts("h")).select("image_id", "tx", "ty")


def tile_coverage(masks: DataFrame, roi: int, stride: int, value: str = "mask") -> DataFrame:
    """Mean of a 0/1 strip column over every window: (image_id, tx, ty, coverage).

    Work per pixel does not depend on the window size. Along x a strip is reduced to sums of
    ``step`` pixels and from those to window sums, inside the scan; along y the sums of ``step``
    rows are combined before the shuffle and a running total gives the windows.
    """
    step = math.gcd(roi, stride)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(value) / step).cast("int") - 1),
        lambda b: F.aggregate(F.slice(value, b * step + 1, step), F.lit(0.0), lambda s, v: s + v),
    )
    window_sums = F.transform(
        F.sequence(F.lit(0), (F.size(value) - roi).cast("int"), F.lit(stride)),
        lambda tx: F.struct(
            tx.cast("bigint").alias("tx"),
            F.aggregate(F.slice("_b", F.floor(tx / step).cast("int") + 1, roi // step), F.lit(0.0), lambda s, v: s + v).alias("s"),
        ),
    )
    rows = masks.filter(F.size(value) >= roi).withColumn("_b", blocks).select("image_id", "y", F.inline(window_sums))
    bands = rows.groupBy("image_id", "tx", F.floor(F.col("y") / step).alias("band")).agg(F.sum("s").alias("s"))
    # strips that are missing are empty: every band of the image's height takes part in the running total
    height = masks.groupBy("image_id").agg(F.floor((F.max("y") + 1) / step).alias("n_bands")).filter("n_bands > 0")
    whole = attach(bands.select("image_id", "tx").distinct(), height, ["image_id"], "inner")
    whole = whole.select("image_id", "tx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bands") - 1)).alias("band"))
    w = W.partitionBy("image_id", "tx").orderBy("band")
    running = w.rowsBetween(W.unboundedPreceding, 0)
    k = roi // step
    return (
        whole.join(bands, ["image_id", "tx", "band"], "left")
        .withColumn("_cum", F.sum(F.coalesce("s", F.lit(0.0))).over(running))
        .withColumn("_before", F.coalesce(F.lag("_cum", k).over(w), F.lit(0.0)))
        .withColumn("ty", (F.col("band") - (k - 1)) * step)
        .filter((F.col("ty") >= 0) & (F.col("ty") % stride == 0))
        .select("image_id", "tx", F.col("ty").cast("bigint").alias("ty"), ((F.col("_cum") - F.col("_before")) / float(roi * roi)).alias("coverage"))
    )


def covered_tiles(masks: DataFrame, roi: int, stride: int, threshold: float, value: str = "mask") -> DataFrame:
    return tile_coverage(masks, roi, stride, value).filter(F.col("coverage") >= threshold)


def tile_sums(pixels: DataFrame, roi: int, stride: int) -> DataFrame:
    """Sum of ``v`` and count of mask pixels per tile, for tiles that do not overlap (stride >= roi).

    The tile of a pixel is computed, not searched for.
    """
    if stride < roi:
        raise ValueError("tiles overlap: use tile_coverage for sliding windows")
    ty, tx = (F.floor(F.col(c) / stride) * stride for c in ("y", "x"))
    inside = (F.col("y") - F.col("ty") < roi) & (F.col("x") - F.col("tx") < roi)
    return (
        pixels.withColumns({"ty": ty, "tx": tx})
        .filter(inside)
        .groupBy("image_id", "ty", "tx")
        .agg(F.sum("v").alias("total"), F.count_if("m").alias("inside"))
    )


def tile_centres(tiles: DataFrame, roi: int, um_per_px: ColumnLike) -> DataFrame:
    return tiles.withColumns(
        {"centre_x_um": (F.col("tx") + roi / 2.0) * col(um_per_px), "centre_y_um": (F.col("ty") + roi / 2.0) * col(um_per_px)}
    )


def centred_roi(boxes: DataFrame, roi: int) -> DataFrame:
    """Top-left corner of the window centred on a bounding box, kept inside the image (h, w)."""

    def corner(lo: str, hi: str, size: str) -> Column:
        middle = F.floor((F.col(lo) + F.col(hi)) / 2)
        return F.greatest(F.lit(0), F.least(middle - roi // 2, F.col(size) - roi))

    return boxes.withColumns({"roi_y0": corner("min_row", "max_row", "h"), "roi_x0": corner("min_col", "max_col", "w")})


# --- neighbourhoods --------------------------------------------------------------------------------


def with_neighbour_rows(strips: DataFrame, value: str) -> DataFrame:
    """Add the strips above and below each row (``up``, ``down``; NULL at the border).

    Every strip is sent to its three rows and grouped there: one shuffle, no sort of an image.
    """
    roles = F.array(
        *[F.struct((F.col("y") + dy).alias("to"), F.lit(role).alias("role")) for dy, role in ((1, "up"), (0, "here"), (-1, "down"))]
    )
    sent = strips.select("image_id", F.col(value).alias("_v"), F.inline(roles))
    out = sent.groupBy("image_id", F.col("to").alias("y")).agg(
        *[F.first(F.when(F.col("role") == r, F.col("_v")), ignorenulls=True).alias(r) for r in ("up", "here", "down")]
    )
    return out.filter("here IS NOT NULL").withColumnRenamed("here", value)


def outline(masks: DataFrame, value: str = "mask") -> DataFrame:
    """Mask pixels with a missing 4-neighbour; outside the image counts as missing."""
    rows = with_neighbour_rows(masks, value)
    at = lambda a, i: F.coalesce(F.get(F.col(a), i), F.lit(0.0))
    flags = F.transform(
        value, lambda v, i: (v > 0) & (F.least(at("up", i), at("down", i), at(value, i - 1), at(value, i + 1)) <= 0)
    )
    return (
        rows.select("image_id", "y", F.posexplode(flags).alias("x", "edge"))
        .filter("edge")
        .select("image_id", "y", F.col("x").cast("bigint").alias("x"))
    )


def _row_pairs(strips: DataFrame, border: str) -> DataFrame:
    """(image_id, qy, a, b): every row of pixels with the one below it; one more pair above and below the image.

    A row that is missing is NULL (``constant``: zeros) or the edge row (``reflect``).
    """
    roles = F.array(
        F.struct((F.col("y") - 1).alias("qy"), F.lit("low").alias("role")), F.struct(F.col("y").alias("qy"), F.lit("high").alias("role"))
    )
    sent = strips.select("image_id", F.col("pixels").alias("_v"), F.inline(roles))
    rows = sent.groupBy("image_id", "qy").agg(
        F.first(F.when(F.col("role") == "high", F.col("_v")), ignorenulls=True).alias("a"),
        F.first(F.when(F.col("role") == "low", F.col("_v")), ignorenulls=True).alias("b"),
    )
    return rows if border == "constant" else rows.select("image_id", "qy", F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b"))


def bilinear_sample(strips: DataFrame, points: DataFrame, border: str = "constant", name: str = "v") -> DataFrame:
    """Add the bilinear value at (sx, sy) to ``points``; one equi-join on the row of each point.

    The row meets its points as an array, of which each point reads two pixels: images are never exploded.
    ``border='constant'``: 0 outside. ``border='reflect'``: the image is mirrored about its edges.
    """
    if border not in ("constant", "reflect"):
        raise ValueError(f"border must be 'constant' or 'reflect', not {border!r}")
    if border == "reflect":
        points = attach(points, image_sizes(strips).withColumnsRenamed({"h": "_h", "w": "_w"}), ["image_id"])

        def mirrored(c: str, size: str) -> Column:
            m = F.pmod(F.col(c) + 0.5, 2.0 * F.col(size))
            return F.least(m, 2.0 * F.col(size) - m) - 0.5

        points = points.withColumns({"_sx": mirrored("sx", "_w"), "_sy": mirrored("sy", "_h")}).drop("_h", "_w")
    else:
        points = points.withColumns({"_sx": F.col("sx"), "_sy": F.col("sy")})
    points = points.withColumns({"qx": F.floor("_sx"), "qy": F.floor("_sy")})
    fx, fy = F.col("_sx") - F.col("qx"), F.col("_sy") - F.col("qy")
    last = F.greatest(F.size(F.coalesce("a", "b")) - 1, F.lit(0)).cast("bigint")

    def pixel(row: str, at: Column) -> Column:
        inside = F.get(F.col(row), F.greatest(F.lit(0).cast("bigint"), F.least(at, last)).cast("int"))
        value = inside if border == "reflect" else F.when((at >= 0) & (at <= last), inside)
        return F.coalesce(value, F.lit(0.0))

    left, right = F.col("qx"), F.col("qx") + 1
    value = (1 - fy) * ((1 - fx) * pixel("a", left) + fx * pixel("a", right)) + fy * ((1 - fx) * pixel("b", left) + fx * pixel("b", right))
    kept = [c for c in points.columns if c not in ("qy", "qx", "_sx", "_sy")]
    found = points.join(_row_pairs(strips, border), ["image_id", "qy"], "left")
    return found.select(*kept, F.coalesce(value, F.lit(0.0)).alias(name))


# --- autocorrelation maps --------------------------------------------------------------------------


def radial_mean(pixels: DataFrame, keys: list[str], cy: ColumnLike, cx: ColumnLike, value: str = "v") -> DataFrame:
    """Mean over rings k <= r < k + 1 around a centre; empty rings are absent."""
    dy, dx = F.col("y") - col(cy), F.col("x") - col(cx)
    ring = F.floor(F.sqrt((dx * dx + dy * dy).cast("double"))).alias("radius")
    return pixels.groupBy(*keys, ring).agg(F.avg(value).alias("mean"))


def locate_trough(
    pixels: DataFrame, keys: list[str], cy: ColumnLike, cx: ColumnLike, r_min: float = 5.0, r_max: ColumnLike | None = None, value: str = "v"
) -> DataFrame:
    """Smallest value outside ``r_min`` (and within ``r_max``), first in row-major order, with its direction.

    A map without a negative value has no trough: NULL fields.
    """
    dy, dx = F.col("y") - col(cy), F.col("x") - col(cx)
    radius = F.sqrt((dx * dx + dy * dy).cast("double"))
    allowed = radius > r_min
    if r_max is not None:
        allowed = allowed & (radius <= col(r_max))
    found = F.min(F.when(allowed & (F.col(value) < 0), F.struct(F.col(value).alias("v"), F.col("y").alias("y"), F.col("x").alias("x"), dy.alias("dy"), dx.alias("dx"))))
    t = pixels.groupBy(*keys).agg(found.alias("_t"))
    rad = F.atan2(F.col("_t.dy").cast("double"), F.col("_t.dx").cast("double"))
    return t.select(
        *keys, F.col("_t.v").alias("trough_value"), F.col("_t.y").alias("trough_y"), F.col("_t.x").alias("trough_x"),
        F.hypot(F.col("_t.dy").cast("double"), F.col("_t.dx").cast("double")).alias("trough_radius"),
        *orientation_columns(rad, "orientation_min"),
    )


def orientation_columns(radians: Column, name: str) -> list[Column]:
    """Angle in radians and degrees, and folded to a half turn."""
    return [
        radians.alias(f"{name}_radians"),
        F.degrees(radians).alias(f"{name}_degrees"),
        F.pmod(F.degrees(radians), F.lit(180.0)).alias(f"{name}_degrees_180"),
    ]


def circle_points(centres: DataFrame, radius: ColumnLike, samples: int = 360) -> DataFrame:
    """``samples`` points on a circle around (cy, cx), as (k, sx, sy)."""
    angle = F.col("k") * F.lit(2 * math.pi / samples)
    return (
        centres.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumns({"sx": F.col("cx") + col(radius) * F.cos(angle), "sy": F.col("cy") + col(radius) * F.sin(angle)})
    )


def circle_maximum(samples: DataFrame, keys: list[str], value: str = "v", n: int = 360) -> DataFrame:
    """Angle of the first largest sample on the circle."""
    best = samples.groupBy(*keys).agg(F.min(F.struct((-F.col(value)).alias("neg"), F.col("k").alias("k"))).alias("_b"))
    return best.select(*keys, (-F.col("_b.neg")).alias("circle_max"), *orientation_columns(F.col("_b.k") * F.lit(2 * math.pi / n), "orientation_max"))


def line_points(centres: DataFrame, length: ColumnLike, radians: ColumnLike) -> DataFrame:
    """Points from (cy, cx) along a direction, both ends included, about one pixel apart: (k, sx, sy, distance)."""
    steps = F.ceil(col(length)).cast("int")
    return (
        centres.withColumn("_n", steps)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
        .withColumn("distance", F.col("k") * col(length) / F.col("_n"))
        .withColumns({"sx": F.col("cx") + F.col("distance") * F.cos(col(radians)), "sy": F.col("cy") + F.col("distance") * F.sin(col(radians))})
        .drop("_n")
    )


def lag_products(pixels: DataFrame, keys: list[str], h: int, w: int) -> DataFrame:
    """Circular autocorrelation of small complete tiles by definition, for checks: (keys, dy, dx, value).

    A tile is one array of h * w values, and all its lags are computed inside the row.
    """
    n = h * w
    tile = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.col("v").alias("v")))), lambda s: s["v"])

    def lag(k):
        def product(total, i):
            y = (F.floor(i / w) + F.floor(k / w)) % h
            x = (i % w + k % w) % w
            return total + F.get("_t", i) * F.get("_t", (y * w + x).cast("int"))

        value = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), product)
        return F.struct(F.floor(k / w).alias("dy"), (k % w).alias("dx"), value.alias("value"))

    tiles = pixels.groupBy(*keys).agg(tile.alias("_t")).filter(F.size("_t") == n)
    return tiles.select(*keys, F.inline(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lag)))


# --- registration ----------------------------------------------------------------------------------


def mask_moments(mask_pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Area, centroid, orientation from the horizontal and axis lengths of a set of pixels (y, x)."""
    m = mask_pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area"),
        F.avg("y").alias("cy"),
        F.avg("x").alias("cx"),
        F.var_pop("y").alias("_vy"),
        F.var_pop("x").alias("_vx"),
        F.covar_pop("y", "x").alias("_cov"),
    )
    vy, vx, cov = F.col("_vy"), F.col("_vx"), F.col("_cov")
    diagonal = F.when(cov < 0, F.lit(-math.pi / 4)).otherwise(F.lit(math.pi / 4))
    from_vertical = F.when(F.abs(vx - vy) < 1e-12, diagonal).otherwise(0.5 * F.atan2(2 * cov, vy - vx))
    mid = (vx + vy) / 2
    spread = F.sqrt((vx - vy) * (vx - vy) / 4 + cov * cov)
    return m.select(
        *keys, "area", "cy", "cx",
        (F.lit(math.pi / 2) - from_vertical).alias("orientation"),
        (4 * F.sqrt(mid + spread)).alias("major"),
        (4 * F.sqrt(F.greatest(mid - spread, F.lit(0.0)))).alias("minor"),
    )


def canvas(images: DataFrame, factor: float = 1.5) -> DataFrame:
    """Enlarged canvas size and the offset that centres the image on it."""
    big = {f"canvas_{c}": F.floor(F.lit(factor) * F.col(c)) for c in ("h", "w")}
    out = images.withColumns(big)
    return out.withColumns({"offset_y": (F.col("canvas_h") - F.col("h")) / 2.0, "offset_x": (F.col("canvas_w") - F.col("w")) / 2.0})


def _rotation_scale(angle_1: Column, sx: Column, sy: Column, angle_2: Column) -> tuple[Column, Column, Column, Column]:
    """Entries of R(angle_2) * diag(sx, sy) * R(angle_1)."""
    c1, s1, c2, s2 = F.cos(angle_1), F.sin(angle_1), F.cos(angle_2), F.sin(angle_2)
    return (
        c2 * sx * c1 - s2 * sy * s1, -c2 * sx * s1 - s2 * sy * c1,
        s2 * sx * c1 + c2 * sy * s1, -s2 * sx * s1 + c2 * sy * c1,
    )


def ellipse_affine(pairs: DataFrame, compose: str = "documented") -> DataFrame:
    """Affine columns m00..m12 mapping ellipse ``s_*`` to ellipse ``t_*`` (cx, cy, orientation, major, minor).

    ``documented``: move to the origin, rotate back, scale, rotate, move to the target.
    ``as_written``: the same five steps applied in the opposite order.
    """
    sx, sy = ratio("t_major", "s_major"), ratio("t_minor", "s_minor")
    if compose == "documented":
        a, b, c, d = _rotation_scale(-F.col("s_orientation"), sx, sy, F.col("t_orientation"))
        in_x, in_y = -F.col("s_cx"), -F.col("s_cy")
        out_x, out_y = F.col("t_cx"), F.col("t_cy")
    elif compose == "as_written":
        a, b, c, d = _rotation_scale(F.col("t_orientation"), sx, sy, -F.col("s_orientation"))
        in_x, in_y = F.col("t_cx"), F.col("t_cy")
        out_x, out_y = -F.col("s_cx"), -F.col("s_cy")
    else:
        raise ValueError(f"compose must be 'documented' or 'as_written', not {compose!r}")
    return pairs.withColumns(
        {"m00": a, "m01": b, "m02": a * in_x + b * in_y + out_x, "m10": c, "m11": d, "m12": c * in_x + d * in_y + out_y}
    )


def warp(strips: DataFrame, transforms: DataFrame, border: str = "constant") -> DataFrame:
    """Inverse-map warp: every pixel of the output canvas samples the source bilinearly.

    ``transforms`` has one row per image: image_id, out_h, out_w and the affine m00..m12.
    """
    det = F.col("m00") * F.col("m11") - F.col("m01") * F.col("m10")
    dx, dy = F.col("x") - F.col("m02"), F.col("y") - F.col("m12")
    grid = (
        transforms.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("out_h") - 1)))
        .repartition("image_id", "y")  # few images, many rows: spread the rows
        .withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("out_w") - 1)))
        .withColumns(
            {
                "sx": (F.col("m11") * dx - F.col("m01") * dy) / det,
                "sy": (F.col("m00") * dy - F.col("m10") * dx) / det,
            }
        )
        .select("image_id", "y", "x", "sx", "sy")
    )
    return bilinear_sample(strips, grid, border).select("image_id", "y", "x", "v")


def to_strips(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Pixels back to row strips (every row complete)."""
    row = F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v"))))
    return pixels.groupBy("image_id", "y").agg(F.transform(row, lambda s: s["v"]).alias("pixels"))


def shift_transform(shifts: DataFrame) -> DataFrame:
    """Pure translation by (delta_x, delta_y) as affine columns."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return shifts.withColumns({"m00": one, "m01": zero, "m02": F.col("delta_x"), "m10": zero, "m11": one, "m12": F.col("delta_y")})


def crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cut out (offset_y, offset_x, h, w) per image and renumber from 0."""
    d = attach(pixels, boxes.select("image_id", F.floor("offset_y").alias("_oy"), F.floor("offset_x").alias("_ox"), "h", "w"), ["image_id"], "inner")
    y, x = F.col("y") - F.col("_oy"), F.col("x") - F.col("_ox")
    inside = (y >= 0) & (y < F.col("h")) & (x >= 0) & (x < F.col("w"))
    return d.filter(inside).withColumns({"y": y, "x": x}).drop("_oy", "_ox", "h", "w")


# --- maps of tile metrics --------------------------------------------------------------------------


def metric_grid(points: DataFrame, keys: list[str], value: str, cells: int = 500, reach: int = 0) -> DataFrame:
    """Mean of ``value`` on a cells x cells grid over the range of the points (px, py) of each key.

    With ``reach`` > 0 each cell mean is spread to the cells around it with inverse-distance weights;
    a cell's own mean outweighs nothing else when it has points.
    """
    present = points.filter(F.col(value).isNotNull())
    span = present.groupBy(*keys).agg(
        F.min("px").alias("_x0"), F.max("px").alias("_x1"), F.min("py").alias("_y0"), F.max("py").alias("_y1")
    )

    def slot(c: str, lo: str, hi: str) -> Column:
        place = F.coalesce(F.try_divide(F.col(c) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0))
        return F.floor(place * (cells - 1) + 0.5).cast("int")

    base = (
        attach(present, span, keys)
        .groupBy(*keys, slot("py", "_y0", "_y1").alias("gy"), slot("px", "_x0", "_x1").alias("gx"))
        .agg(F.avg(value).alias("mean"))
    )
    if reach == 0:
        return base
    offsets = F.array(
        *[
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1.0 / (dy * dy + dx * dx) if dy or dx else 1e12).alias("wt"))
            for dy in range(-reach, reach + 1)
            for dx in range(-reach, reach + 1)
        ]
    )
    spread = base.select(*keys, "gy", "gx", "mean", F.inline(offsets)).withColumns({"gy": F.col("gy") + F.col("dy"), "gx": F.col("gx") + F.col("dx")})
    return (
        spread.filter(F.col("gy").between(0, cells - 1) & F.col("gx").between(0, cells - 1))
        .groupBy(*keys, "gy", "gx")
        .agg((F.sum(F.col("wt") * F.col("mean")) / F.sum("wt")).alias("mean"))
    )


def failed_tiles(metrics: DataFrame, metric: str = "second_positive_distance_microns") -> DataFrame:
    return metrics.filter(F.col(metric).isNull())


