"""Permutation tests of a patch / interpatch mean ratio.

The statistic only needs the two sums, so the pixels are first collapsed to (group, value, count).
A permutation is then a draw without replacement from those counts: the same distribution as
shuffling all pixels, at a cost that depends on the number of distinct values. Values are spread
over buckets, and iterations over chunks. The buckets of a group are the leaves of a binary tree: what
falls into the left half of a node is drawn once and handed down, level by level, so every total is drawn
in one task and the work grows in proportion to the number of values.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.scalar import ratio
from axonframe.operators.attach import attach
from axonframe.operators.ordered import CHUNK_ROWS, cumulative, exact_quantiles
from axonframe.session import durable, spread

LEVELS_PER_BUCKET = 4096
NUMPY_LIMIT = 1_000_000_000  # largest population that the library's generator takes
SINGLE_DRAWS = 64
CELLS = 1 << 20  # counts held at a time: iterations x levels


def hypergeometric(rng, good, bad, draws) -> np.ndarray:
    """How many of ``draws`` items taken without replacement are good (elementwise).

    Populations beyond NumPy's limit are drawn in steps that stay exact: every item is taken with the same
    chance, by two binomial counts, and the surplus or lack (about its square root) is put back or added in
    the same way, until so few are left that they are drawn one by one.
    """
    good, bad, draws = (np.asarray(v, dtype=np.int64) for v in np.broadcast_arrays(good, bad, draws))
    if max(good.max(initial=0), bad.max(initial=0)) < NUMPY_LIMIT:
        return rng.hypergeometric(good, bad, draws)
    x, y = np.zeros_like(good), np.zeros_like(bad)
    need = draws - x - y
    while (np.abs(need) > SINGLE_DRAWS).any():
        add, more, less = need > 0, np.maximum(need, 0), np.maximum(-need, 0)
        far = np.abs(need) > SINGLE_DRAWS
        left = (np.where(add, good - x, x), np.where(add, bad - y, y))
        chance = np.where(far, (more + less) / np.maximum(left[0] + left[1], 1), 0.0)
        sign = np.where(add, 1, -1)
        x, y = x + sign * rng.binomial(left[0], chance), y + sign * rng.binomial(left[1], chance)
        need = draws - x - y
    for _ in range(SINGLE_DRAWS):
        sign = np.sign(need)
        left = (np.where(sign > 0, good - x, x), np.where(sign > 0, bad - y, y))
        hit = rng.random(need.shape) * (left[0] + left[1]) < left[0]
        x, y = x + sign * hit, y + sign * ~hit
        need = draws - x - y
    return x


def _take(rng, pool, sizes: np.ndarray) -> np.ndarray:
    """How many of each level are among ``size`` items taken from the pool, one row per iteration.

    ``pool`` holds the items of each level, one row for all iterations or one row each. NumPy draws a whole row at a
    time: item by item where a level has few, level by level else, and what takes the whole pool is not drawn.
    """
    totals = np.broadcast_to(pool.sum(axis=-1), sizes.shape)
    if (sizes == totals).all():
        return np.broadcast_to(pool, (len(sizes), pool.shape[-1]))
    if totals.max() >= NUMPY_LIMIT:
        return _take_by_level(rng, pool, sizes)
    out = np.empty((len(sizes), pool.shape[-1]), np.int64)
    if pool.ndim == 1:
        for size in np.unique(sizes):
            rows = sizes == size
            out[rows] = rng.multivariate_hypergeometric(pool, size, int(rows.sum()), method=_method(pool.size, totals[0], size))
    else:
        for i, (row, total, size) in enumerate(zip(pool, totals, sizes)):
            out[i] = rng.multivariate_hypergeometric(row, size, method=_method(row.size, total, size))
    return out


def _method(levels: int, total: int, size: int) -> str:
    return "count" if total <= 64 * levels and min(size, total - size) <= 8 * levels else "marginals"


def _take_by_level(rng, pool, sizes: np.ndarray) -> np.ndarray:
    pool = np.broadcast_to(pool, (len(sizes), pool.shape[-1]))
    out, beyond, open_ = np.empty(pool.shape, np.int64), pool.sum(axis=1), sizes
    for level in range(pool.shape[1]):
        here = pool[:, level]
        beyond = beyond - here
        out[:, level] = hypergeometric(rng, here, beyond, open_)
        open_ = open_ - out[:, level]
    return out


def class_sums(rng, counts: np.ndarray, values: np.ndarray, sizes: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of the values that fall to each class, taken without replacement, for all iterations at once.

    ``sizes`` has one array per class. What no class takes is set aside first.
    """
    step = max(1, CELLS // max(1, len(counts)))
    parts = []
    for at in range(0, len(sizes[0]), step):
        some = [size[at : at + step] for size in sizes]
        union = sum(some)
        pool = counts if (union == counts.sum()).all() else _take(rng, counts, union)
        sums = []
        for size in some:
            if size.any():
                taken = _take(rng, pool, size)
                pool = pool - taken
            else:
                taken = 0 * counts
            sums.append(np.broadcast_to(taken @ values, size.shape))
        parts.append(sums)
    return [np.concatenate(c) for c in zip(*parts)]


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def _handed_down(state: DataFrame, per_bucket: DataFrame, depth: int, seed: int) -> DataFrame:
    """Class sizes of the root of every group and chunk, split down the tree to its buckets.

    ``state``: (key, node, chunk, classes); ``per_bucket``: (key, bucket, n). Level by level a node draws, in one
    task, how many of each class fall into its left half.
    """

    def split(level):
        def run(batches):
            for pdf in batches:
                rows = []
                for k, node, chunk, left, right, classes in zip(pdf["_key"], pdf["_node"], pdf["_chunk"], pdf["_left"], pdf["_right"], pdf["_classes"]):
                    rng = np.random.default_rng(_seed(seed, k, chunk, level, node))
                    sides = [[], []]
                    here, beyond = int(left), int(right)
                    for size in (np.asarray(c, np.int64) for c in classes):
                        taken = hypergeometric(rng, here, beyond, size)
                        here, beyond = here - taken, beyond - (size - taken)
                        sides[0].append(taken)
                        sides[1].append(size - taken)
                    rows += [(k, 2 * node + i, chunk, side) for i, (side, n) in enumerate(zip(sides, (left, right))) if n]
                yield pd.DataFrame(rows, columns=["_key", "_node", "_chunk", "_classes"])

        return run

    for level in range(depth):
        shift = depth - 1 - level
        half = F.shiftright("_bucket", shift)
        bit = half.bitwiseAND(F.lit(1)) == 0
        totals = per_bucket.groupBy(F.col("_key"), F.shiftright(half, 1).alias("_node")).agg(F.sum(F.when(bit, F.col("_n")).otherwise(0)).alias("_left"), F.sum(F.when(~bit, F.col("_n")).otherwise(0)).alias("_right"))
        joined = spread(state.join(totals, ["_key", "_node"]), "_key", "_node", "_chunk")
        state = joined.mapInPandas(split(level), "_key string, _node int, _chunk int, _classes array<array<bigint>>")
    return state


def permutation_sums(levels: DataFrame, by: list[str], n_iter: int, seed: int, chunk: int = 1000) -> DataFrame:
    """(by..., iter, sum_patch, sum_inter) of ``n_iter`` permutations.

    ``levels`` has by..., value, n (pixels), n_patch, n_inter, n_both (pixels of the masks and of both).
    """
    key = F.concat_ws("|", *[F.coalesce(F.col(b).cast("string"), F.lit("NULL")) for b in by]).alias("_key")
    totals = levels.groupBy(*by).agg(F.count(F.lit(1)).alias("_levels"), F.sum("n_patch").alias("_p"), F.sum("n_inter").alias("_i"), F.sum("n_both").alias("_b"))
    totals = durable(totals.select("*", key))
    most = totals.agg(F.max("_levels")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, most / LEVELS_PER_BUCKET))))
    per_bucket = (
        levels.select(key, "value", "n", F.pmod(F.xxhash64("value"), F.lit(1 << depth)).cast("int").alias("_bucket"))
        .groupBy("_key", "_bucket")
        .agg(F.sum("n").alias("_n"), F.sort_array(F.collect_list(F.struct("value", "n"))).alias("_items"))
        .select("_key", "_bucket", "_n", F.col("_items.value").alias("_values"), F.col("_items.n").alias("_counts"))
    )
    per_bucket = durable(per_bucket) if depth else per_bucket
    chunks = [(c, min(chunk, n_iter - c * chunk)) for c in range(math.ceil(n_iter / chunk))]
    sizes = F.element_at(F.array(*[F.lit(n) for _, n in chunks]), F.col("_chunk") + 1)
    classes = F.array(*[F.array_repeat(c.cast("bigint"), sizes) for c in (F.col("_p") - F.col("_b"), F.col("_i") - F.col("_b"), F.col("_b"))])
    roots = totals.select("_key", "_p", "_i", "_b", F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1))).alias("_chunk"))
    state = roots.select("_key", F.lit(0).alias("_node"), "_chunk", classes.alias("_classes"))
    state = _handed_down(state, per_bucket.select("_key", "_bucket", "_n"), depth, seed)
    tasks = spread(per_bucket.withColumnRenamed("_bucket", "_node").join(state, ["_key", "_node"]), "_key", "_node", "_chunk")

    def draw(batches):
        for pdf in batches:
            for k, node, c, values, counts, classes in zip(pdf["_key"], pdf["_node"], pdf["_chunk"], pdf["_values"], pdf["_counts"], pdf["_classes"]):
                rng = np.random.default_rng(_seed(seed, k, c, "bucket", node))
                first, second, shared = class_sums(rng, np.asarray(counts, np.int64), np.asarray(values, float), [np.asarray(x, np.int64) for x in classes])
                yield pd.DataFrame({"_key": k, "iter": np.arange(len(first)) + int(c) * chunk, "sum_patch": first + shared, "sum_inter": second + shared})

    parts = tasks.select("_key", "_node", "_chunk", "_values", "_counts", "_classes").mapInPandas(draw, "_key string, iter long, sum_patch double, sum_inter double")
    sums = parts.groupBy("_key", "iter").agg(F.sum("sum_patch").alias("sum_patch"), F.sum("sum_inter").alias("sum_inter"))
    return sums.join(totals.select("_key", *by), "_key").select(*by, "iter", "sum_patch", "sum_inter")


def permutation_test(
    pixels: DataFrame, by: list[str], value: str, patch: Column, interpatch: Column,
    n_iter: int = 10_000, alpha: float = 0.05, seed: int = 0, population: str = "image",
) -> DataFrame:
    """Observed ratio, its permutation bounds, significance and two-sided empirical p per group.

    ``population='image'`` shuffles all pixels of the group, ``'masks'`` only those under a mask.
    The masks may overlap: a pixel under both counts in both sums. A NULL ratio has NULL significance.
    """
    if population not in ("image", "masks"):
        raise ValueError(f"population must be 'image' or 'masks', not {population!r}")
    a, b = F.coalesce(patch, F.lit(False)), F.coalesce(interpatch, F.lit(False))
    d = pixels.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("value"), a.alias("_a"), b.alias("_b"))
    if population == "masks":
        d = d.filter("_a OR _b")
    levels = d.groupBy(*by, "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_a").alias("n_patch"), F.count_if("_b").alias("n_inter"), F.count_if(F.col("_a") & F.col("_b")).alias("n_both")
    )
    observed = levels.groupBy(*by).agg(
        F.sum("n_patch").alias("n_patch"), F.sum("n_inter").alias("n_interpatch"),
        F.sum(F.col("value") * F.col("n_patch")).alias("_sp"), F.sum(F.col("value") * F.col("n_inter")).alias("_si"),
    )
    observed = observed.withColumn("ratio", ratio(ratio("_sp", "n_patch"), ratio("_si", "n_interpatch")))
    sums = permutation_sums(levels, by, n_iter, seed)
    shuffled = attach(sums, observed.select(*by, "n_patch", "n_interpatch", "ratio"), by)
    shuffled = shuffled.withColumn("r", ratio(ratio("sum_patch", "n_patch"), ratio("sum_inter", "n_interpatch")))
    # n_iter rows per group: a bounded group
    bounds = shuffled.groupBy(*by).agg(
        F.percentile("r", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_q"),
        F.avg("r").alias("shuffle_mean"),
        F.count_if(F.col("r") >= F.col("ratio")).alias("_ge"),
        F.count_if(F.col("r") <= F.col("ratio")).alias("_le"),
        F.count("r").alias("n_shuffles"),
    )
    out = attach(observed, bounds, by)
    low, high = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    p = F.least(F.lit(1.0), 2.0 * (F.least("_ge", "_le") + 1) / (F.col("n_shuffles") + 1))
    return out.select(
        *by, "n_patch", "n_interpatch", "ratio", low.alias("low"), high.alias("high"), "shuffle_mean",
        ((F.col("ratio") < low) | (F.col("ratio") > high)).alias("significant"),
        F.when(F.col("ratio").isNotNull(), p).alias("p_empirical"), "n_shuffles",
    )


def keyed_permutations(
    pixels: DataFrame, by: list[str], value: str, pixel_id: Column, n_patch: Column | str, n_iter: int, seed: str = "s",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """A few reproducible permutations: pixels ordered by a hash of (seed, iteration, pixel id).

    The first ``n_patch`` in that order are the patch, the rest the interpatch. For audits; the
    number of rows is pixels x iterations, so use :func:`permutation_test` for real tests.
    """
    keyed = pixels.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1)))).withColumn(
        "_h", F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("iter"), pixel_id)), 1, 15), 16, 10).cast("bigint")
    )
    per_key = keyed.groupBy(*by, "iter", "_h").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("_v"), F.max(n_patch).alias("_k"))
    ordered = cumulative(per_key, [*by, "iter"], "_h", chunk_rows=chunk_rows)
    first = F.col("cum_before") < F.col("_k")
    s = ordered.groupBy(*by, "iter").agg(
        F.sum(F.when(first, F.col("_v"))).alias("_sp"), F.sum(F.when(~first, F.col("_v"))).alias("_si"),
        F.max("_k").alias("_k"), F.max("total").alias("_n"),
    )
    return s.select(*by, "iter", ratio(ratio("_sp", "_k"), ratio("_si", F.col("_n") - F.col("_k"))).alias("ratio"))


def shuffle_bounds(ratios: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    return exact_quantiles(ratios, by, "ratio", [alpha / 2, 1 - alpha / 2], ["low", "high"])


def null_moments(pixels: DataFrame, by: list[str], value: str, patch: Column) -> DataFrame:
    """Mean and variance of the patch mean under permutation, in closed form (sampling without replacement)."""
    d = pixels.groupBy(*by).agg(
        F.avg(value).alias("null_mean"), F.var_pop(value).alias("_v"), F.count(value).alias("_n"), F.count(F.when(patch, F.col(value))).alias("_k")
    )
    n, k = F.col("_n").cast("double"), F.col("_k").cast("double")
    return d.select(*by, "null_mean", (ratio("_v", k) * ratio(n - k, n - 1)).alias("null_variance"))


def null_ratio(levels: DataFrame, by: list[str]) -> DataFrame:
    """(by..., null_sd): standard deviation of the logarithm of the ratio under permutation, from its moments.

    Both means have the same expectation; they are drawn without replacement from ``n`` pixels, so their covariance
    is that of disjoint samples. ``levels`` has by..., value, n, n_patch, n_inter.
    """
    s = levels.groupBy(*by).agg(
        F.sum("n").cast("double").alias("_n"), F.sum("n_patch").cast("double").alias("_k"), F.sum("n_inter").cast("double").alias("_l"),
        F.sum(F.col("value") * F.col("n")).alias("_s"), F.sum(F.col("value") * F.col("value") * F.col("n")).alias("_q"),
    )
    n, k, m = F.col("_n"), F.col("_k"), F.col("_l")
    mean = F.col("_s") / n
    spread_ = ratio(F.col("_q") / n - mean * mean, mean * mean) * (ratio(n - k, k) + ratio(n - m, m) + 2) / (n - 1)
    return s.select(*by, F.sqrt(spread_).alias("null_sd"))
