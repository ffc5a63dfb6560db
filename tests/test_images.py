"""Tile kernel, warps, components and permutations against brute force and known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import components, permute, raster, series, tiles
from axonframe.plans import patches, tilemap


def strips_of(spark, images: dict, name="pixels"):
    rows = [(i, y, [float(v) for v in row]) for i, img in images.items() for y, row in enumerate(img)]
    return spark.createDataFrame(rows, f"image_id long, y long, {name} array<double>").repartition(5)


def test_disc_tophat_and_gaussian_by_brute_force():
    rng = np.random.default_rng(0)
    img = rng.random((9, 11))
    r = 3
    pad = np.pad(img, r, mode="symmetric")
    disc = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]

    def extreme(a, fn):
        p = np.pad(a, r, mode="symmetric")
        return fn([p[r + dy : r + dy + 9, r + dx : r + dx + 11] for dy, dx in disc], axis=0)

    assert np.allclose(tiles.disc_minimum(img, r), np.min([pad[r + dy : r + dy + 9, r + dx : r + dx + 11] for dy, dx in disc], axis=0))
    assert np.allclose(tiles.white_tophat(img, r), img - extreme(extreme(img, np.min), np.max))
    k = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    k /= k.sum()
    p = np.pad(img, 6, mode="symmetric")
    brute = sum(a * b * p[6 + i : 15 + i, 6 + j : 17 + j] for i, a in zip(range(-6, 7), k) for j, b in zip(range(-6, 7), k))
    assert np.allclose(tiles.gaussian(img, 1.5), brute)


def test_autocorrelation_centre_symmetry_and_correction():
    rng = np.random.default_rng(1)
    p = tiles.TileParams(roi=12, pad_factor=2.0)
    tile = rng.random((12, 12))
    acf = tiles.autocorrelation(tile, p)
    n = p.padded
    c = n // 2
    assert acf[c, c] == pytest.approx(1)
    assert np.allclose(acf[1:, 1:], acf[1:, 1:][::-1, ::-1])
    z = tile - tile.mean()
    lag = (z[2:, :-3] * z[:-2, 3:]).mean() / (z * z).mean()  # dy = -2, dx = 3 without wrap-around
    assert acf[c - 2, c + 3] == pytest.approx(lag)


def test_grating_half_width_and_orientation(spark):
    period = 16.0
    y, x = np.mgrid[0:64, 0:64]
    p = tiles.TileParams(roi=32, stride=32, background_radius=None, sigma_small=None, pad_factor=2.0, r_min=3.0, r_max=10.0)
    strips = strips_of(spark, {5: np.cos(2 * math.pi * x / period) * np.cos(2 * math.pi * y / 32)})
    t = raster.enumerate_tiles(spark.createDataFrame([(5, 64, 64)], "image_id long, h long, w long"), 32, 32)
    maps = tiles.tile_maps(strips, t, p)
    m = tiles.tile_metrics(maps, F.lit(2.0), "line", p).collect()
    assert len(m) == 4
    for row in m:
        assert row["orientation_min_degrees_180"] == pytest.approx(0, abs=8) or row["orientation_min_degrees_180"] > 172
        assert row["r_half_pixels"] == pytest.approx(period / 6, abs=0.4)
        assert row["r_half_microns"] == pytest.approx(2 * row["r_half_pixels"])
        assert row["first_negative_amp"] < -0.9


def test_tiles_match_single_process_and_partitioning(spark):
    rng = np.random.default_rng(2)
    img = rng.random((50, 70))
    p = tiles.TileParams(roi=12, stride=5, background_radius=2, sigma_small=1.0, sigma_large=3.0)
    t = raster.enumerate_tiles(spark.createDataFrame([(1, 50, 70)], "image_id long, h long, w long"), p.roi, p.stride)
    got = {(r["ty"], r["tx"]): r for r in tiles.tile_maps(strips_of(spark, {1: img}), t.repartition(3), p).collect()}
    assert set(got) == {(y, x) for y in range(0, 39, 5) for x in range(0, 59, 5)}
    geometry = tiles._geometry(p)
    for (ty, tx), row in list(got.items())[::7]:
        want = tiles.describe(tiles.autocorrelation(tiles.prepare(img[ty : ty + 12, tx : tx + 12], p), p), p, geometry)
        assert row["profile"] == pytest.approx(want["profile"])
        assert row["trough_value"] == pytest.approx(want["trough_value"])


def test_series_expressions(spark):
    def one(expr, values):
        return spark.createDataFrame([(values,)], "s array<double>").select(expr("s").alias("o")).first()["o"]

    assert one(series.half_width, [1.0, 0.8, 0.3, 0.1]) == pytest.approx(1.6)
    assert one(series.half_width, [1.0, 0.9]) is None
    run = one(series.negative_run_trough, [1.0, -0.1, -0.4, -0.2, 0.3, -0.9])
    assert (run["index"], run["value"]) == (2, -0.4)
    assert one(series.negative_run_trough, [1.0, 0.5])["index"] is None
    assert one(series.first_peak_index, [1.0, 0.2, 0.4, 0.3]) == 2
    cubic = [0.01 * i**3 - 0.2 * i * i + i for i in range(20)]
    assert one(series.savgol, cubic) == pytest.approx(cubic)
    assert one(series.savgol, [1.0] * 10) is None


def test_coverage_sizes(spark):
    rng = np.random.default_rng(4)
    for h, w, roi, stride in ((23, 31, 6, 4), (20, 20, 5, 3), (8, 9, 8, 10)):
        m = (rng.random((h, w)) > 0.4).astype(float)
        got = {(r["ty"], r["tx"]): r["coverage"] for r in raster.tile_coverage(strips_of(spark, {0: m}, "mask"), roi, stride).collect()}
        want = {(y, x): m[y : y + roi, x : x + roi].mean() for y in range(0, h - roi + 1, stride) for x in range(0, w - roi + 1, stride)}
        assert got == pytest.approx(want)


def test_identity_warp_and_registration(spark):
    y, x = np.mgrid[0:40, 0:50]
    blob = (((x - 27) / 14) ** 2 + ((y - 18) / 8) ** 2 <= 1).astype(float)
    s = strips_of(spark, {0: blob})
    eye = spark.createDataFrame([(0, 40, 50, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "image_id long, out_h long, out_w long, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double")
    got = {(r["y"], r["x"]): r["v"] for r in raster.warp(s, eye).collect()}
    assert got == {(a, b): blob[a, b] for a in range(40) for b in range(50)}

    target = (((x - 20) / 9) ** 2 + ((y - 22) / 12) ** 2 <= 1).astype(float)
    both = raster.mask_moments(
        spark.createDataFrame([(k, int(a), int(b)) for k, m in (("s", blob), ("t", target)) for a, b in np.argwhere(m > 0)], "k string, y long, x long"), ["k"]
    )
    part = {r["k"]: r for r in both.collect()}
    assert part["s"]["major"] == pytest.approx(28, rel=0.03) and part["s"]["minor"] == pytest.approx(16, rel=0.03)
    cols = ("cx", "cy", "orientation", "major", "minor")
    row = [0, *[float(part["s"][c]) for c in cols], *[float(part["t"][c]) for c in cols], 40, 50]
    pair = spark.createDataFrame([row], "image_id long, " + ", ".join(f"{k}_{c} double" for k in "st" for c in cols) + ", h long, w long")
    pair = raster.canvas(pair).withColumns({"t_cx": F.col("t_cx") + F.col("offset_x"), "t_cy": F.col("t_cy") + F.col("offset_y")})
    tr = raster.ellipse_affine(pair).withColumns({"out_h": F.col("canvas_h"), "out_w": F.col("canvas_w")})
    shift = tilemap.residual_shift(s, tr).first()
    assert abs(shift["delta_x"]) < 0.5 and abs(shift["delta_y"]) < 0.5
    out = tilemap.register(s, s, tr).collect()
    assert len(out) == 2000
    inside = np.zeros((40, 50))
    for r in out:
        inside[r["y"], r["x"]] = r["inside"]
    overlap = (inside * target).sum() / np.maximum(inside, target).sum()
    assert overlap > 0.9


def test_components_on_a_spiral_and_singles(spark):
    m = np.zeros((31, 31))
    y, x, dy, dx = 0, 0, 0, 1
    for leg in range(30, 0, -2):  # one long winding path, gaps of one pixel
        for _ in range(2):
            for _ in range(leg):
                m[y, x] = 1
                y, x = y + dy, x + dx
            dy, dx = dx, -dy
    m[15, 15] = 0
    other = np.eye(6)
    s = strips_of(spark, {0: m, 1: other, 2: np.zeros((3, 3))}, "mask")
    runs = components.connected_runs(s)
    boxes = {(r["image_id"]): r for r in components.largest_component(s).collect()}
    assert boxes[1]["area"] == 6 and 2 not in boxes
    assert components.component_boxes(runs).filter("image_id = 0").agg(F.sum("area")).first()[0] == m.sum()
    seen, want = set(), 0
    for start in map(tuple, np.argwhere(m > 0)):
        if start in seen:
            continue
        stack, size = [start], 0
        seen.add(start)
        while stack:
            a, b = stack.pop()
            size += 1
            for p in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if p not in seen and 0 <= p[0] < 31 and 0 <= p[1] < 31 and m[p]:
                    seen.add(p)
                    stack.append(p)
        want = max(want, size)
    assert boxes[0]["area"] == want


def test_outline_of_a_square(spark):
    m = np.zeros((6, 6))
    m[1:5, 1:5] = 1
    got = {(r["y"], r["x"]) for r in raster.outline(strips_of(spark, {0: m}, "mask")).collect()}
    assert got == {(y, x) for y in range(1, 5) for x in range(1, 5)} - {(2, 2), (2, 3), (3, 2), (3, 3)}


def pixel_rows(spark, rng, n=900):
    v = rng.integers(0, 30, n).astype(float)
    kind = rng.integers(0, 3, n)
    return v, kind, spark.createDataFrame([("i", float(a), bool(k == 0), bool(k == 1)) for a, k in zip(v, kind)], "img string, v double, patch boolean, interpatch boolean")


def test_permutation_matches_shuffling_and_ignores_partitions(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v, kind, df = pixel_rows(spark, rng)
    got = patches.per_image(df, ["img"], n_iter=3000).first()
    again = patches.per_image(df.repartition(13), ["img"], n_iter=3000).first()
    assert got == again
    sims = []
    for _ in range(3000):
        w = rng.permutation(v)
        sims.append(w[kind == 0].mean() / w[kind == 1].mean())
    assert got["ratio"] == pytest.approx(v[kind == 0].mean() / v[kind == 1].mean())
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(sims, [0.025, 0.975])), abs=0.01)
    monkeypatch.setattr(permute, "LEVELS_PER_BUCKET", 4)  # several buckets per group
    split = patches.per_image(df, ["img"], n_iter=3000).first()
    assert (split["low"], split["high"]) == pytest.approx((got["low"], got["high"]), abs=0.012)


def test_pooled_permutation_and_overlap(spark):
    _, _, df = pixel_rows(spark, np.random.default_rng(8))
    got = patches.pooled(df.withColumn("all", F.lit(1)), ["img"], ["all"], n_iter=500).first()
    assert got["low"] < got["shuffle_mean"] < got["high"]


def test_permutation_of_overlapping_masks(spark):
    rng = np.random.default_rng(12)
    v = rng.integers(1, 40, 400).astype(float)
    a, b = rng.random(400) < 0.4, rng.random(400) < 0.5
    df = spark.createDataFrame([("m", float(x), bool(p), bool(q)) for x, p, q in zip(v, a, b)], "img string, v double, a boolean, b boolean")
    got = permute.permutation_test(df, ["img"], "v", F.col("a"), F.col("b"), n_iter=3000).first()
    sims = []
    for _ in range(3000):
        w = rng.permutation(v)
        sims.append(w[a].mean() / w[b].mean())
    assert got["ratio"] == pytest.approx(v[a].mean() / v[b].mean()) and got["n_patch"] == a.sum() and got["n_interpatch"] == b.sum()
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(sims, [0.025, 0.975])), abs=0.012)


def test_splitting_tree_keeps_totals(spark, monkeypatch):
    monkeypatch.setattr(permute, "LEVELS_PER_BUCKET", 3)
    rows = [("g", float(v), n, n // 3, n // 4, 0) for v, n in zip(range(60), range(1, 61))] + [(None, 1.0, 7, 3, 4, 0)]
    levels = spark.createDataFrame(rows, "g string, value double, n long, n_patch long, n_inter long, n_both long")
    sums = permute.permutation_sums(levels, ["g"], 2000, 1, chunk=500)
    got = {r["g"]: r for r in sums.groupBy("g").agg(F.count("*").alias("k"), F.avg("sum_patch").alias("m"), F.stddev("sum_patch").alias("sd")).collect()}
    assert got["g"]["k"] == got[None]["k"] == 2000 and got[None]["m"] == 3 and got[None]["sd"] == 0
    v = np.repeat(np.arange(60), np.arange(1, 61)).astype(float)
    k, n = sum(x // 3 for x in range(1, 61)), len(v)
    sd = math.sqrt(k * v.var() * (n - k) / (n - 1))
    assert abs(got["g"]["m"] - k * v.mean()) < 5 * sd / math.sqrt(2000) and got["g"]["sd"] == pytest.approx(sd, rel=0.08)


def test_permutation_draws_whole_rows_of_counts():
    class Counting:
        def __init__(self):
            self.rng, self.calls = np.random.default_rng(4), 0

        def __getattr__(self, name):
            self.calls += 1
            return getattr(self.rng, name)

    counts, k = np.arange(1, 301), 9000
    values = np.arange(300) * 1.0
    flat = np.repeat(values, counts)
    n, rng = len(flat), Counting()
    first, second, shared = permute.class_sums(rng, counts, values, [np.full(2000, k), np.full(2000, n - k), np.zeros(2000, int)])
    assert rng.calls < 10  # not one for every level
    assert first + second == pytest.approx(flat.sum()) and (shared == 0).all()
    sd = math.sqrt(k * flat.var() * (n - k) / (n - 1))
    assert abs(first.mean() - k * flat.mean()) < 5 * sd / math.sqrt(2000) and first.std() == pytest.approx(sd, rel=0.08)


@pytest.mark.parametrize("limit", [0, 1_000_000_000])
@pytest.mark.parametrize("scale", [1, 50])
def test_class_sums_of_varied_sizes(monkeypatch, limit, scale):
    monkeypatch.setattr(permute, "NUMPY_LIMIT", limit)
    monkeypatch.setattr(permute, "CELLS", 7000)
    rng = np.random.default_rng(6)
    counts, values = np.array([3, 1, 8, 30, 2, 0]) * scale, np.array([1.0, 10.0, 100.0, 1000.0, 1e4, 1e5])
    sizes = [rng.integers(0, 10 * scale, 3000), np.full(3000, 15 * scale), rng.integers(0, 12 * scale, 3000)]
    n = counts.sum()
    flat = np.repeat(values, counts)
    for size, got in zip(sizes, permute.class_sums(rng, counts, values, sizes)):
        excess = got - size * flat.mean()
        var = size * flat.var() * (n - size) / (n - 1)
        assert got.shape == (3000,) and abs(excess.mean()) < 5 * math.sqrt(var.mean() / 3000)
        assert (excess * excess).mean() == pytest.approx(var.mean(), rel=0.12)


def test_coverage_with_missing_strips(spark):
    rows = [(1, y, [1.0] * 8) for y in (0, 1, 4, 5, 6, 7)]
    got = {(r["tx"], r["ty"]): r["coverage"] for r in raster.tile_coverage(spark.createDataFrame(rows, "image_id int, y int, mask array<double>"), 4, 2).collect()}
    assert got == {(x, y): c for x in (0, 2, 4) for y, c in ((0, 0.5), (2, 0.5), (4, 1.0))}


def test_large_population_draws(monkeypatch):
    monkeypatch.setattr(permute, "NUMPY_LIMIT", 0)
    rng = np.random.default_rng(9)
    good, bad, k = 600, 1400, 300
    draws = permute.hypergeometric(rng, np.full(20_000, good), np.full(20_000, bad), np.full(20_000, k))
    var = k * 0.3 * 0.7 * (2000 - k) / 1999
    assert draws.mean() == pytest.approx(90, abs=0.3) and draws.var() == pytest.approx(var, rel=0.05)
    n = 10**13
    huge = permute.hypergeometric(rng, np.full(40_000, n), np.full(40_000, n), np.full(40_000, n)).astype(float)
    sd = math.sqrt(n * 0.25 * n / (2 * n - 1))
    assert abs(huge.mean() - n / 2) < 5 * sd / 200 and huge.std() == pytest.approx(sd, rel=0.03)
    big = permute.hypergeometric(rng, 3_000_000_000, 7_000_000_000, np.full(5000, 1_000_000))
    assert big.mean() == pytest.approx(300_000, abs=30) and big.std() == pytest.approx(math.sqrt(1e6 * 0.21), rel=0.05)
