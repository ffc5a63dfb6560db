"""Patch / interpatch permutation analyses per image and pooled over animals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.operators import permute, summarise


def per_image(pixels: DataFrame, keys: list[str], n_iter: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Each image on its own; all its pixels are shuffled. ``pixels`` has v, patch, interpatch."""
    return permute.permutation_test(pixels, keys, "v", F.col("patch"), F.col("interpatch"), n_iter, alpha, seed)


def pooled(pixels: DataFrame, image_keys: list[str], keys: list[str], n_iter: int = 50_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Images divided by their patch mean and pooled by ``keys``; only masked pixels are shuffled."""
    masked = pixels.filter("patch OR interpatch")
    scaled = summarise.normalise_by_mean(masked, image_keys, "v", F.col("patch"))
    return permute.permutation_test(scaled, keys, "v", F.col("patch"), F.col("interpatch"), n_iter, alpha, seed, "masks")
