"""Column hygiene: names, tolerant projection, coercion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snake_case(name: str) -> str:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower()


def clean_names(df: DataFrame) -> DataFrame:
    """snake_case names; repeated ones get _2, _3, ..."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        base = snake_case(c) or "x"
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop columns without a header (``...1``, ``_c0``, or empty)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c and not re.match(r"^(\.\.\.\d*|_c\d+)$", c)])


def any_of(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Keep the listed columns; one that is absent becomes a NULL of the given type."""
    have = set(df.columns)
    return df.select(
        *[F.col(f"`{c}`") if c in have else F.lit(None).cast(t).alias(c) for c, t in schema.items()]
    )


def to_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast to double; junk becomes NULL instead of an error."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in cols if c in df.columns})
