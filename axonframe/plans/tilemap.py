"""Registered tile map: moments, affine warp, residual shift, crop, tiles, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.scalar import ColumnLike
from axonframe.operators import raster, tiles
from axonframe.operators.attach import attach


def residual_shift(masks: DataFrame, transforms: DataFrame) -> DataFrame:
    """Translation that still separates the warped mask's centroid from (t_cx, t_cy)."""
    warped = raster.warp(masks, transforms).filter("v > 0.5")
    centre = raster.mask_moments(warped, ["image_id"]).select("image_id", "cx", "cy")
    return attach(transforms.select("image_id", "t_cx", "t_cy", "out_h", "out_w"), centre, ["image_id"], "inner").select(
        "image_id", "out_h", "out_w", (F.col("t_cx") - F.col("cx")).alias("delta_x"), (F.col("t_cy") - F.col("cy")).alias("delta_y")
    )


def _twice(strips: DataFrame, first: DataFrame, second: DataFrame, binary: bool) -> DataFrame:
    once = raster.warp(strips, first)
    if binary:
        once = once.withColumn("v", F.when(F.col("v") > 0.5, 1.0).otherwise(0.0))
    return raster.warp(raster.to_strips(once), second)


def register(images: DataFrame, masks: DataFrame, transforms: DataFrame) -> DataFrame:
    """Warp image and mask onto the canvas, remove the residual shift, crop to the target size.

    ``transforms`` is the output of ``ellipse_affine`` on ``canvas`` rows (h, w, offset_y, offset_x,
    out_h, out_w, t_cx, t_cy and the matrix). Returns (image_id, y, x, v, inside).
    """
    matrix = [f"m{i}{j}" for i in (0, 1) for j in (0, 1, 2)]
    first = transforms.select("image_id", "out_h", "out_w", *matrix)
    second = raster.shift_transform(residual_shift(masks, transforms)).select("image_id", "out_h", "out_w", *matrix)
    boxes = transforms.select("image_id", "offset_y", "offset_x", "h", "w")
    grey = raster.crop(_twice(images, first, second, binary=False), boxes)
    mask = raster.crop(_twice(masks, first, second, binary=True), boxes)
    inside = mask.select("image_id", "y", "x", (F.col("v") > 0.5).alias("inside"))
    return grey.join(inside, ["image_id", "y", "x"])


def tile_map(
    registered: DataFrame, um_per_px: ColumnLike, coverage: float = 0.9, method: str = "local_max", p: tiles.TileParams = tiles.TileParams()
) -> DataFrame:
    """Metrics of every sufficiently covered tile of registered images."""
    grey = raster.to_strips(registered)
    masks = raster.to_strips(registered.withColumn("m", F.when(F.col("inside"), 1.0).otherwise(0.0)), "m").withColumnRenamed("pixels", "mask")
    chosen = raster.covered_tiles(masks, p.roi, p.stride, coverage)
    return tiles.tile_metrics(tiles.tile_maps(grey, chosen, p), um_per_px, method, p)
