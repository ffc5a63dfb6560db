"""Rasters as row-strip tables: (image_id, y, pixels array<double>), plus an images table.

Decoded rasters are stored as Parquet strips; decoding image files is not part of the package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRIP_SCHEMA = "image_id bigint, y bigint, pixels array<double>"


def read_strips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STRIP_SCHEMA).parquet(path)


def write_strips(strips: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Strips sorted within files by image and row, so that row ranges can be skipped on reading."""
    strips.select("image_id", "y", "pixels").sortWithinPartitions("image_id", "y").write.mode(mode).parquet(path)


def long_view(strips: DataFrame, value: str = "pixels", name: str = "v") -> DataFrame:
    """(image_id, y, x, v), one row per pixel."""
    return strips.select("image_id", "y", F.posexplode(value).alias("x", name)).withColumn("x", F.col("x").cast("bigint"))


def image_sizes(strips: DataFrame, value: str = "pixels") -> DataFrame:
    return strips.groupBy("image_id").agg(
        (F.max("y") + 1).alias("h"), F.max(F.size(value)).cast("bigint").alias("w")
    )


def binarise(strips: DataFrame, value: str, threshold: float | None = None, equals: float | None = None) -> DataFrame:
    """Replace a strip column by 0/1: above ``threshold``, or equal to ``equals``."""
    if (threshold is None) == (equals is None):
        raise ValueError("give either threshold or equals")
    test = (lambda v: v > threshold) if equals is None else (lambda v: v == equals)
    return strips.withColumn(value, F.transform(value, lambda v: F.when(test(v), 1.0).otherwise(0.0)))


def mask_select(strips: DataFrame, masks: DataFrame) -> DataFrame:
    """Pixels under the mask. Strips and masks meet row by row, not pixel by pixel."""
    both = strips.join(masks, ["image_id", "y"]).select("image_id", "y", F.arrays_zip("pixels", "mask").alias("z"))
    return (
        both.select("image_id", "y", F.posexplode("z").alias("x", "z"))
        .filter("z.mask > 0")
        .select("image_id", "y", F.col("x").cast("bigint").alias("x"), F.col("z.pixels").alias("v"))
    )


def pixel_sizes(images: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Add ``um_per_px`` from the horizontal resolution fraction and flag unequal resolutions.

    ``images`` has x_num, x_den, y_num, y_den.
    """
    x, y = F.try_divide("x_num", "x_den"), F.try_divide("y_num", "y_den")
    return images.withColumns({"um_per_px": x, "resolution_mismatch": F.abs(x - y) > tolerance})
