"""Cumulative counts, ranks and exact quantiles of groups of any size.

Raw rows are first collapsed to distinct values with counts. A group with more than
``CHUNK_ROWS`` distinct values is cut into value ranges, so that no task sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.attach import null_safe_join
from axonframe.session import BROADCAST_ROWS, durable

CHUNK_ROWS = 500_000
PIECES = 256


def distinct_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n) without missing values; map-side combined."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def _with_chunks(d: DataFrame, by: list[str], value: str, chunk_rows: int) -> DataFrame | None:
    """Add ``_chunk``, increasing with the value; None if every group is small.

    The rows are counted: size estimates do not see what generators and explodes add.
    """
    if d.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > chunk_rows).isEmpty():
        return None
    cuts = [i / PIECES for i in range(1, PIECES)]
    bounds = (
        d.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx(value, cuts, 20 * PIECES).alias("_bounds"))
        .filter(F.col("_rows") > chunk_rows)
        .select(*by, "_bounds")
    )
    # Any bounds give exact results if both uses below see the same ones: hence durable.
    bounds = durable(bounds)
    if bounds.count() <= BROADCAST_ROWS // PIECES:
        bounds = F.broadcast(bounds)
    below = F.size(F.filter(F.col("_bounds"), lambda b: b < F.col(value)))
    return (
        null_safe_join(d, bounds, by, "left")
        .withColumn("_chunk", F.when(F.col("_bounds").isNull(), 0).otherwise(below))
        .drop("_bounds")
    )


def cumulative(
    d: DataFrame, by: list[str], value: str, n: str = "n", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``cum_before`` (count of smaller values) and ``total`` per group.

    ``d`` has one row per (by, value). It is written once, as it is counted before it is used.
    """
    d = durable(d)
    chunked = _with_chunks(d, by, value, chunk_rows)
    if chunked is None:
        w = W.partitionBy(*by)
        before = w.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return d.withColumn("cum_before", F.coalesce(F.sum(n).over(before), F.lit(0))).withColumn(
            "total", F.sum(n).over(w)
        )
    w = W.partitionBy(*by)
    starts = (
        chunked.groupBy(*by, "_chunk")
        .agg(F.sum(n).alias("_n"))
        .withColumn(
            "_start", F.coalesce(F.sum("_n").over(w.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        )
        .withColumn("total", F.sum("_n").over(w))
        .drop("_n")
    )
    inside = W.partitionBy(*by, "_chunk").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        null_safe_join(chunked, starts, [*by, "_chunk"])
        .withColumn("cum_before", F.col("_start") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .drop("_start", "_chunk")
    )


def average_ranks(d: DataFrame, by: list[str], value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(by, value, n) -> adds ``avg_rank``, ``cum_before``, ``total``."""
    return cumulative(d, by, value, chunk_rows=chunk_rows).withColumn(
        "avg_rank", F.col("cum_before") + (F.col("n") + 1) / F.lit(2.0)
    )


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: list[float], names: list[str], chunk_rows: int = CHUNK_ROWS, counts: DataFrame | None = None
) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per probability.

    ``counts``: the group's :func:`distinct_counts`, if they are at hand.
    """
    c = cumulative(distinct_counts(df, by, value) if counts is None else counts, by, value, chunk_rows=chunk_rows)
    aggs = []
    for p, name in zip(probs, names):
        low = F.floor((F.col("total") - 1) * F.lit(float(p)))
        high = F.ceil((F.col("total") - 1) * F.lit(float(p)))
        for k, tag in ((low, "lo"), (high, "hi")):
            hit = (F.col("cum_before") <= k) & (k < F.col("cum_before") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{tag}"))
    out = c.groupBy(*by).agg(F.max("total").alias("_total"), *aggs)
    cols = []
    for p, name in zip(probs, names):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*by, *cols)


def gather_pieces(df: DataFrame, by: list[str], value: str, size: int = 4096, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sorted values of each group as arrays of at most ``size`` values: (by, piece, vec).

    A group is never collected as a whole, and a frequent value is divided over its pieces.
    """
    c = cumulative(distinct_counts(df, by, value), by, value, chunk_rows=chunk_rows)
    first, end = F.col("cum_before"), F.col("cum_before") + F.col("n")
    pieces = F.sequence(F.floor(first / size), F.floor((end - 1) / size))
    parts = c.withColumn("piece", F.explode(pieces))
    copies = F.least(end, (F.col("piece") + 1) * size) - F.greatest(first, F.col("piece") * size)
    runs = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), copies.cast("int").alias("k"))))
    return parts.groupBy(*by, "piece").agg(F.flatten(F.transform(runs, lambda r: F.array_repeat(r["v"], r["k"]))).alias("vec"))
