"""Representative rows per group.

Spark has no row order, so every pick takes ``ordinal`` columns as last sort keys; they stand for
the position in the source file. Top-1 filters let Spark limit each group before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.attach import attach
from axonframe.operators.ordered import exact_quantiles


def _asc(cols) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in cols]


def first_in_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per group (a NULL key is a group), the first in ``order``."""
    w = W.partitionBy(*keys).orderBy(*_asc(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def all_first_in_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """As :func:`first_in_group`, keeping every row tied for first."""
    w = W.partitionBy(*keys).orderBy(*_asc(order))
    return df.withColumn("_rk", F.rank().over(w)).filter("_rk = 1").drop("_rk")


def slice_min(df: DataFrame, keys: list[str], by: str, ordinal: list[str] | None = None) -> DataFrame:
    """Row(s) with the smallest ``by``: one row if ``ordinal`` is given, else all ties."""
    if ordinal is None:
        return all_first_in_group(df, keys, [by])
    return first_in_group(df, keys, [by, *ordinal])


def slice_max(df: DataFrame, keys: list[str], by: str, ordinal: list[str]) -> DataFrame:
    return first_in_group(df, keys, [F.col(by).desc_nulls_last(), *ordinal])


def pair_dedup(df: DataFrame, a: str, b: str, ordinal: list[str]) -> DataFrame:
    """1:1 pairs: the smallest ``b`` per ``a``, then the smallest ``a`` per ``b``."""
    return slice_min(slice_min(df, [a], b, ordinal), [b], a, ordinal)


def nearest(df: DataFrame, keys: list[str], by: str, target: float, ordinal: list[str]) -> DataFrame:
    """First row nearest to ``target``; a group with no value yields no row."""
    distance = F.abs(F.col(by) - F.lit(float(target)))
    return first_in_group(df.filter(F.col(by).isNotNull()), keys, [distance.asc(), *ordinal])


def nearest_to_median(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows nearest to their group's median, ties kept; adds ``dist_to_median``."""
    medians = exact_quantiles(df, keys, by, [0.5], ["_median"])
    out = attach(df, medians, keys).withColumn("dist_to_median", F.abs(F.col(by) - F.col("_median"))).drop("_median")
    return all_first_in_group(out, keys, ["dist_to_median"])


def group_mode(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value per group; of equally frequent ones the smallest."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("count"))
    return first_in_group(counts, keys, [F.col("count").desc(), value]).withColumnRenamed(value, name)
