"""Autocorrelation of sliding tiles.

Row strips are cut into blocks of about two tile widths plus the overlap their tiles need; one task
works on one block and serves all its tiles, so a pixel is shipped a few times, not once per tile.
Only the image kernel is Python (NumPy on Arrow batches); it returns short arrays, and every metric
is then a Spark expression on them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.scalar import ColumnLike, col, next_power_of_two_int
from axonframe.operators import series
from axonframe.operators.raster import orientation_columns
from axonframe.session import broadcast_if_small, fan_out


@dataclass(frozen=True)
class TileParams:
    """Kernel settings; the defaults are the full-size workload."""

    roi: int = 330
    stride: int = 10
    background_radius: int | None = 50
    sigma_small: float | None = 3.0
    sigma_large: float = 40.0
    pad_factor: float = 1.3  # below 2 large lags wrap around; 2 is free of that
    finite_size: str = "corrected"  # or "as_written": a reference of ones, which cancels
    r_min: float = 5.0
    r_max: float | None = None  # pixels
    circle_samples: int = 360
    filter_scope: str = "tile"  # or "block": filter once per block (differs near tile edges)
    keep_maps: bool = False

    @property
    def block(self) -> int:
        """Block edge: a multiple of the stride, about two tiles."""
        return max(1, 2 * self.roi // self.stride) * self.stride

    @property
    def padded(self) -> int:
        return next_power_of_two_int(math.ceil(self.pad_factor * self.roi))


def reflect_index(n: int, before: int, after: int) -> np.ndarray:
    """Source index of positions -before..n+after-1 mirrored about the edges (edge pixel repeated)."""
    i = np.arange(-before, n + after) % (2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def _running_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum over ``width`` consecutive entries of the last axis, by doubling."""
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[..., : out.shape[-1] - step], out[..., step:])
        have += step
    return out


def disc_minimum(img: np.ndarray, radius: int) -> np.ndarray:
    """Minimum over a disc, edges mirrored: one running minimum per disc row width."""
    h, w = img.shape
    rows = img[np.ix_(reflect_index(h, radius, radius), reflect_index(w, radius, radius))]
    halves = {dy: int(math.isqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1)}
    by_half = {half: _running_min(rows[:, radius - half : radius + half + w], 2 * half + 1) for half in set(halves.values())}
    out = np.full((h, w), np.inf)
    for dy, half in halves.items():
        np.minimum(out, by_half[half][radius + dy : radius + dy + h], out=out)
    return out


def white_tophat(img: np.ndarray, radius: int) -> np.ndarray:
    """Image minus its opening by a disc."""
    eroded = disc_minimum(img, radius)
    return img + disc_minimum(-eroded, radius)


def gaussian_operator(n: int, sigma: float) -> np.ndarray:
    """Matrix that smooths a signal of length n: Gaussian cut off at four sigma, edges mirrored."""
    r = int(4.0 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    source = reflect_index(n, r, r)
    out = np.zeros((n, n))
    for j, wt in enumerate(k):
        np.add.at(out, (np.arange(n), source[j : j + n]), wt)
    return out


def gaussian(img: np.ndarray, sigma: float, known: dict | None = None) -> np.ndarray:
    """``known`` keeps the matrices of a task's equally sized tiles."""
    known = {} if known is None else known
    for n in img.shape:
        if (n, sigma) not in known:
            known[n, sigma] = gaussian_operator(n, sigma)
    return known[img.shape[0], sigma] @ img @ known[img.shape[1], sigma].T


def prepare(img: np.ndarray, p: TileParams, known: dict | None = None) -> np.ndarray:
    """Background removal and difference of Gaussians."""
    if p.background_radius:
        img = white_tophat(img, p.background_radius)
    if p.sigma_small is not None:
        img = gaussian(img, p.sigma_small, known) - gaussian(img, p.sigma_large, known)
    return img


def autocorrelation(tile: np.ndarray, p: TileParams) -> np.ndarray:
    """Autocorrelation map on a power-of-two canvas, mean removed, centre = 1."""
    n = p.padded
    h, w = tile.shape
    canvas = np.zeros((n, n))
    canvas[:h, :w] = tile - tile.mean()
    acf = np.fft.irfft2(np.abs(np.fft.rfft2(canvas)) ** 2, s=(n, n))
    if p.finite_size == "corrected":
        ones = np.zeros((n, n))
        ones[:h, :w] = 1.0
        overlap = np.rint(np.fft.irfft2(np.abs(np.fft.rfft2(ones)) ** 2, s=(n, n)))
        acf = acf / np.where(overlap < 0.5, 1.0, overlap)
    acf = np.fft.fftshift(acf)
    centre = acf[n // 2, n // 2]
    return acf / centre if centre != 0 else acf


def bilinear_reflect(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = []
    for c, n in ((y, img.shape[0]), (x, img.shape[1])):
        m = np.mod(c + 0.5, 2.0 * n)
        m = np.minimum(m, 2.0 * n - m) - 0.5
        low = np.floor(m).astype(int)
        out.append((np.clip(low, 0, n - 1), np.clip(low + 1, 0, n - 1), m - low))
    (y0, y1, fy), (x0, x1, fx) = out
    return (1 - fy) * ((1 - fx) * img[y0, x0] + fx * img[y0, x1]) + fy * ((1 - fx) * img[y1, x0] + fx * img[y1, x1])


def _geometry(p: TileParams):
    n, c = p.padded, p.padded // 2
    yy, xx = np.indices((n, n)) - c
    r = np.hypot(yy, xx)
    allowed = r > p.r_min
    if p.r_max is not None:
        allowed &= r <= p.r_max
    ring = np.floor(r).astype(int).ravel()
    return ring, np.bincount(ring, minlength=c + 1)[: c + 1], allowed


def describe(acf: np.ndarray, p: TileParams, geometry) -> dict:
    """Profile, trough and the samples on the trough circle and line of one map."""
    ring, counts, allowed = geometry
    c = p.padded // 2
    sums = np.bincount(ring, weights=acf.ravel(), minlength=c + 1)[: c + 1]
    profile = [float(s / k) if k else None for s, k in zip(sums, counts)]
    row = {"profile": profile, "trough_value": None, "trough_dy": None, "trough_dx": None, "circle": None, "line": None}
    candidates = np.where(allowed & (acf < 0), acf, np.inf)
    at = int(np.argmin(candidates))  # first in row-major order
    if np.isfinite(candidates.flat[at]):
        dy, dx = at // p.padded - c, at % p.padded - c
        radius = math.hypot(dy, dx)
        angles = 2 * math.pi * np.arange(p.circle_samples) / p.circle_samples
        steps = np.arange(c + 1)
        row.update(
            trough_value=float(acf.flat[at]),
            trough_dy=dy,
            trough_dx=dx,
            circle=bilinear_reflect(acf, c + radius * np.sin(angles), c + radius * np.cos(angles)).tolist(),
            line=bilinear_reflect(acf, c + steps * dy / radius, c + steps * dx / radius).tolist(),
        )
    if p.keep_maps:
        row["map"] = acf.ravel().tolist()
    return row


RESULT = (
    "image_id bigint, tx bigint, ty bigint, profile array<double>, trough_value double, trough_dy int, trough_dx int,"
    " circle array<double>, line array<double>"
)


def block_strips(strips: DataFrame, p: TileParams) -> DataFrame:
    """(image_id, by, bx, y, segment): each strip cut for the blocks that need it."""
    b = p.block
    low = F.greatest(F.lit(0), F.ceil((F.col("y") - (b - p.stride) - (p.roi - 1)) / b)).cast("int")
    high = F.floor(F.col("y") / b).cast("int")
    last_bx = F.floor(F.greatest(F.size("pixels") - p.roi, F.lit(0)) / b).cast("int")
    return (
        strips.withColumn("by", F.explode(F.sequence(low, high)))
        .withColumn("bx", F.explode(F.sequence(F.lit(0), last_bx)))
        .select("image_id", "by", "bx", "y", F.slice("pixels", F.col("bx") * b + 1, b - p.stride + p.roi).alias("segment"))
    )


def tile_maps(strips: DataFrame, tiles: DataFrame, p: TileParams) -> DataFrame:
    """Run the kernel on the given tiles (image_id, tx, ty)."""
    keys = ["image_id", "by", "bx"]
    placed = tiles.select(
        "image_id", F.floor(F.col("ty") / p.block).cast("int").alias("by"), F.floor(F.col("tx") / p.block).cast("int").alias("bx"), "tx", "ty"
    )
    wanted = broadcast_if_small(placed.select(*keys).distinct())
    segments = block_strips(strips, p).join(wanted, keys, "left_semi")
    columns = [c.split()[0] for c in RESULT.split(", ")] + (["map"] if p.keep_maps else [])

    def work(key: tuple, rows: pd.DataFrame, wanted_tiles: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or wanted_tiles.empty:
            return pd.DataFrame(columns=columns)
        rows = rows.sort_values("y")
        block = np.vstack(rows["segment"].to_numpy())
        top, left = int(rows["y"].iloc[0]), int(key[2]) * p.block
        known: dict = {}
        if p.filter_scope == "block":
            block = prepare(block, p, known)
        geometry = _geometry(p)
        out = []
        for tx, ty in zip(wanted_tiles["tx"], wanted_tiles["ty"]):
            tile = block[ty - top : ty - top + p.roi, tx - left : tx - left + p.roi]
            if p.filter_scope != "block":
                tile = prepare(tile, p, known)
            out.append({"image_id": key[0], "tx": tx, "ty": ty, **describe(autocorrelation(tile, p), p, geometry)})
        frame = pd.DataFrame(out, columns=columns)
        for c in ("trough_dy", "trough_dx"):
            frame[c] = frame[c].astype("Int32")
        return frame

    schema = RESULT + (", map array<double>" if p.keep_maps else "")
    # fresh column ids: both sides may come from the same table
    n = fan_out(segments)
    left, right = (d.toDF(*d.columns).repartition(n, *keys).groupBy(*keys) for d in (segments, placed))
    return left.cogroup(right).applyInPandas(work, schema)


def tile_metrics(maps: DataFrame, um_per_px: ColumnLike, method: str = "local_max", p: TileParams = TileParams()) -> DataFrame:
    """Metrics of every tile from its profile (``local_max``) or from its trough line (``derivative``)."""
    scale = col(um_per_px)
    angle_max = series.argmax_index("circle") * F.lit(2 * math.pi / p.circle_samples)
    angle_min = F.atan2(F.col("trough_dy").cast("double"), F.col("trough_dx").cast("double"))
    out = maps.withColumns({"_dmax": angle_max, "_dmin": angle_min})
    metrics = series.profile_metrics("line" if method == "line" else "profile", scale, method)
    return out.select(
        "image_id", "tx", "ty", metrics.alias("_m"),
        *orientation_columns(F.col("_dmax"), "orientation_max"), *orientation_columns(F.col("_dmin"), "orientation_min"),
    ).select("image_id", "tx", "ty", "_m.*", *[f"orientation_{e}_{u}" for e in ("max", "min") for u in ("radians", "degrees", "degrees_180")])

