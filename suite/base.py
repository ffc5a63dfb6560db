"""Registry, table loading and small helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.scalar import col


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
HALF = 0.500001


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def num(c, name: str, digits: int = 6) -> Column:
    """Double output column rounded half up, by the same IEEE steps as :func:`r`.

    A mean of few decimals can lie on a tie, which the order of a sum moves by its last bit: what is a millionth of
    a digit below a tie goes up as well.
    """
    scale = F.lit(10.0**digits)
    return (F.floor(col(c).cast("double") * scale + HALF).cast("double") / scale).alias(name)


def big(c, name: str) -> Column:
    return col(c).cast("bigint").alias(name)


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`num`."""
    return f"(CAST(floor(CAST({expr} AS DOUBLE) * 1e{digits} + {HALF}e0) AS BIGINT) / 1e{digits})"


def b(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"
