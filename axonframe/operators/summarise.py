"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.dist import t_half_width
from axonframe.functions.scalar import ratio
from axonframe.operators.attach import attach
from axonframe.operators.ordered import distinct_counts, exact_quantiles
from axonframe.session import durable


def group_means(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Mean of several columns, missing values skipped; NULL keys form groups."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def sem(c: str) -> Column:
    """Standard error: the count is of present values only."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def mean_table(df: DataFrame, keys: list[str], value: str, ci: bool = False) -> DataFrame:
    """mean, sem, n_rows and n_valid per group; with ``ci`` the half-width of the 95 % t interval."""
    out = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        sem(value).alias("sem"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_valid"),
    )
    return out.withColumn("ci", t_half_width(F.col("sem"), F.col("n_valid"))) if ci else out


def spread_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, max, sd, exact median and count per group."""
    basic = df.groupBy(*keys).agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_samp(value).alias("sd"),
        F.count(value).alias("n"),
    )
    return attach(basic, exact_quantiles(df, keys, value, [0.5], ["median"]), keys)


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width bins over each group's range; the last bin includes its right edge."""
    d = distinct_counts(df, keys, value)
    ranges = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    slot = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), width), F.lit(0.0))
    return (
        attach(d, ranges, keys)
        .withColumn("bin", F.least(F.floor(slot), F.lit(bins - 1)).cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.sum("n").alias("count"))
    )


def density(df: DataFrame, keys: list[str], value: str, points: int = 512, cut: float = 3.0, bins: int = 2048) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth 0.9 min(sd, IQR/1.34) n^-1/5.

    Values are binned linearly: each gives its weight to the two nearest points of a finer grid (about ``bins`` points), in
    proportion to its distance from them. The kernel meets that grid, so its cost depends on the grids alone; bins and
    grid points more than nine bandwidths apart (the kernel is below 1e-17 of its peak) are left out.
    """
    fine = max(1, bins // points)
    counts = durable(distinct_counts(df, keys, value))
    x, n = F.col(value).cast("double"), F.col("n")
    moments = counts.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(n * x) / F.sum(n)).alias("_mean"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    centred = attach(counts, moments.select(*keys, "_mean"), keys).groupBy(*keys).agg(F.sum(n * F.pow(x - F.col("_mean"), 2)).alias("_ss"))
    stats = attach(moments, centred, keys).withColumn("_sd", F.sqrt(F.try_divide("_ss", F.col("_n") - 1)))
    stats = attach(stats, exact_quantiles(df, keys, value, [0.25, 0.75], ["_q1", "_q3"], counts=counts), keys)
    iqr = (F.col("_q3") - F.col("_q1")) / F.lit(1.34)
    scale = F.when(iqr > 0, F.least(F.col("_sd"), iqr)).otherwise(F.col("_sd"))
    stats = stats.withColumn("_bw", F.lit(0.9) * scale * F.pow(F.col("_n"), F.lit(-0.2))).filter("_bw > 0")
    start = F.col("_lo") - cut * F.col("_bw")
    step = (F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_bw")) / F.lit(float(points - 1))
    stats = durable(stats.select(*keys, "_n", "_bw", start.alias("_start"), step.alias("_step")))
    at = (x - F.col("_start")) * fine / F.col("_step")
    low = F.floor(at)
    two = F.array(F.struct(low.alias("bin"), (n * (low + 1 - at)).alias("w")), F.struct((low + 1).alias("bin"), (n * (at - low)).alias("w")))
    bins = attach(counts, stats, keys, "inner").select(*keys, F.inline(two)).groupBy(*keys, "bin").agg(F.sum("w").alias("w"))
    bins = attach(bins, stats, keys, "inner")
    centre = F.col("_start") + F.col("bin") * F.col("_step") / fine
    u = (F.col("grid_x") - centre) / F.col("_bw")
    reach = lambda s: (centre + s * 9 * F.col("_bw") - F.col("_start")) / F.col("_step")
    near = F.sequence(F.greatest(F.ceil(reach(-1)), F.lit(0)).cast("int"), F.least(F.floor(reach(1)), F.lit(points - 1)).cast("int"))
    # grid points far from every value have density zero
    empty = stats.select(*keys, F.lit(None).cast("bigint").alias("bin"), F.lit(0.0).alias("w"), "_n", "_bw", "_start", "_step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid"))
    return (
        bins.withColumn("grid", F.explode(near))
        .unionByName(empty)
        .withColumn("grid_x", F.col("_start") + F.col("grid") * F.col("_step"))
        .groupBy(*keys, "grid")
        .agg(
            F.max("grid_x").alias("x"),
            (F.sum(F.coalesce(F.col("w") * F.exp(-u * u / 2), F.lit(0.0))) / F.max(F.col("_n") * F.col("_bw") * F.lit((2 * 3.141592653589793) ** 0.5))).alias("density"),
        )
    )


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact quartiles, whiskers at the last value within 1.5 IQR, number of outliers."""
    counts = durable(distinct_counts(df, keys, value))
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"], counts=counts)
    low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= low) & (F.col(value) <= high)
    return (
        attach(counts, q, keys)
        .groupBy(*keys)
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("n_outliers"),
        )
    )


def linear_fit(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """slope, intercept, r2, standard error of the slope and n per group."""
    out = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
    )
    var = ratio((1 - F.col("r2")) * F.col("_syy"), (F.col("n") - 2) * F.col("_sxx"))
    return out.withColumn("slope_se", F.when(F.col("n") > 2, F.sqrt(var))).drop("_sxx", "_syy")


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count(F.when(both, 1)).alias("n"))


def masked_ratio(df: DataFrame, keys: list[str], value: str, a: Column, b: Column) -> DataFrame:
    """Means of ``value`` under two conditions and their ratio; NULL ratio on a zero mean."""
    return (
        df.groupBy(*keys)
        .agg(
            F.avg(F.when(a, F.col(value))).alias("mean_patch"),
            F.avg(F.when(b, F.col(value))).alias("mean_interpatch"),
            F.count(F.when(a, F.col(value))).alias("n_patch"),
            F.count(F.when(b, F.col(value))).alias("n_interpatch"),
        )
        .withColumn("ratio", ratio("mean_patch", "mean_interpatch"))
    )


def normalise_by_mean(df: DataFrame, keys: list[str], value: str, where: Column) -> DataFrame:
    """Divide by the group's mean under ``where`` if that is positive."""
    means = df.filter(where).groupBy(*keys).agg(F.avg(value).alias("_m"))
    m = F.col("_m")
    return attach(df, means, keys).withColumn(value, F.when(m > 0, F.col(value) / m).otherwise(F.col(value))).drop("_m")


def min_max_scale(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(v - min) / (max - min) within the group; NULL in a flat group."""
    r = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = ratio(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return attach(df, r, keys).withColumn(name, scaled).drop("_lo", "_hi")


def z_score(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(v - mean) / sample sd within the group."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"))
    return attach(df, s, keys).withColumn(name, ratio(F.col(value) - F.col("_m"), F.col("_sd"))).drop("_m", "_sd")


def percentile_bounds(df: DataFrame, keys: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    return exact_quantiles(df, keys, value, [alpha / 2, 1 - alpha / 2], ["low", "high"])


def none_true(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """True for groups in which the flag never holds."""
    any_true = F.coalesce(F.bool_or(flag), F.lit(False))
    return df.groupBy(*keys).agg((~any_true).alias("all_false"))


def extent(df: DataFrame, keys: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """Bounding box (upper ends exclusive) and area of a set of pixels."""
    return df.groupBy(*keys).agg(
        F.min(y).alias("min_row"),
        F.min(x).alias("min_col"),
        (F.max(y) + 1).alias("max_row"),
        (F.max(x) + 1).alias("max_col"),
        F.count(F.lit(1)).alias("area"),
    )
