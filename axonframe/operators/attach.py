"""Joins that add group summaries or dimension columns to a large table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.session import BROADCAST_ROWS, auto_broadcast_bytes, durable, estimated_bytes


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key; the keys appear once."""
    renamed = b
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = reduce(Column.__and__, [a[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return a.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def attach(df: DataFrame, summary: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Add the columns of a one-row-per-key ``summary`` to ``df``.

    If Spark's own estimate already lets it broadcast the summary, the join is left to it. Otherwise
    the summary is materialised once and counted: up to ``BROADCAST_ROWS`` rows it is broadcast, so
    ``df`` is not shuffled and a hot key does no harm; beyond that it is an ordinary join, where
    adaptive execution splits skewed partitions.
    """
    if estimated_bytes(summary) <= auto_broadcast_bytes(df.sparkSession):
        return null_safe_join(df, summary, keys, how)
    summary = durable(summary)
    if summary.count() <= BROADCAST_ROWS:
        summary = F.broadcast(summary)
    return null_safe_join(df, summary, keys, how)
