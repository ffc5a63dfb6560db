"""Stacking, pivoting and splitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bind_rows(*dfs: DataFrame) -> DataFrame:
    """Stack by column name; columns a table lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.toDF(*d.columns) for d in dfs])


def pivot_longer(df: DataFrame, ids: list[str], cols: list[str], names_to: str, values_to: str) -> DataFrame:
    return df.unpivot(ids, cols, names_to, values_to)


def pivot_wider(df: DataFrame, ids: list[str], level: str, value: str, levels: list, names: list[str]) -> DataFrame:
    """One column per listed level."""
    return df.groupBy(*ids).agg(
        *[F.max(F.when(F.col(level) == F.lit(lv), F.col(value))).alias(nm) for lv, nm in zip(levels, names)]
    )


def complete_cases(df: DataFrame, subject: list[str], level: str, value: str, levels: list) -> DataFrame:
    """Rows of the subjects that have a value at every level, one row per subject and level."""
    wide = pivot_wider(df, subject, level, value, levels, [f"_v{i}" for i in range(len(levels))])
    wide = wide.dropna(subset=[f"_v{i}" for i in range(len(levels))])
    cells = F.array(
        *[F.struct(F.lit(lv).alias(level), F.col(f"_v{i}").alias(value)) for i, lv in enumerate(levels)]
    )
    return wide.select(*subject, F.inline(cells))


def separate(df: DataFrame, col: str, into: list[str], sep: str) -> DataFrame:
    """Split a text column into named parts; a missing part is NULL."""
    parts = F.split(F.col(col), sep)
    return df.select("*", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(into)])


def grid(df: DataFrame, axes: dict[str, tuple]) -> DataFrame:
    """Cartesian grid of integer axes (start, stop, step as columns) for each row of ``df``."""
    for name, (start, stop, step) in axes.items():
        span = F.when(stop >= start, F.sequence(start, stop, step))
        df = df.withColumn(name, F.explode(span))
    return df
