"""Pairing of subsets of one table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.operators.attach import attach, null_safe_join


def pair_join(
    df: DataFrame,
    first: Column,
    second: Column,
    keys: list[str],
    values: list[str],
    suffixes: tuple[str, str],
    how: str = "inner",
) -> DataFrame:
    """Join the rows matching ``first`` to those matching ``second`` on ``keys`` (NULL equals NULL)."""
    sides = [
        df.filter(cond).select(*keys, *[F.col(v).alias(v + suffix) for v in values])
        for cond, suffix in zip((first, second), suffixes)
    ]
    return null_safe_join(sides[0], sides[1], keys, how)


def pair_unique(
    df: DataFrame, first: Column, second: Column, keys: list[str], values: list[str], suffixes: tuple[str, str]
) -> DataFrame:
    """Left pairing in one pass, for keys that are unique on both sides."""
    aggs = [
        F.max(F.when(cond, F.col(v))).alias(v + suffix)
        for cond, suffix in zip((first, second), suffixes)
        for v in values
    ]
    return (
        df.filter(first | second)
        .groupBy(*keys)
        .agg(F.max(F.when(first, F.lit(1))).alias("_has"), *aggs)
        .filter("_has = 1")
        .drop("_has")
    )


def dimension_join(df: DataFrame, dim: DataFrame, left_keys: list[str], dim_keys: list[str]) -> DataFrame:
    """Left join to a dimension whose keys have other names."""
    for left, right in zip(left_keys, dim_keys):
        dim = dim.withColumnRenamed(right, left)
    return attach(df, dim, left_keys)


def level_pairs(df: DataFrame, subject: list[str], level: str, value: str, levels: list) -> DataFrame:
    """For each subject all pairs (level_a before level_b) with both values present.

    One aggregation over an explicit level list; no self-join.
    """
    order = list(levels)
    wide = df.groupBy(*subject).agg(
        *[F.avg(F.when(F.col(level) == F.lit(lv), F.col(value))).alias(f"_v{i}") for i, lv in enumerate(order)]
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(order[a]).alias("level_a"),
                F.lit(order[b]).alias("level_b"),
                F.col(f"_v{a}").alias("value_a"),
                F.col(f"_v{b}").alias("value_b"),
            )
            for a, b in combinations(range(len(order)), 2)
        ]
    )
    return wide.select(*subject, F.inline(pairs)).filter("value_a IS NOT NULL AND value_b IS NOT NULL")
