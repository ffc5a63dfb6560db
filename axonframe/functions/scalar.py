"""Small column expressions with the missing-value rules of the analyses.

NULL is the only missing value: NaN is turned into NULL at the boundary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: ColumnLike) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b as double; NULL when b is 0 or either side is NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def paste(*cols: ColumnLike, sep: str = "_") -> Column:
    """Join values into one key; a missing part is written as NA instead of being skipped."""
    return F.concat_ws(sep, *[F.coalesce(col(c).cast("string"), F.lit("NA")) for c in cols])


def if_else(cond: Column, yes: Column, no: Column) -> Column:
    """Conditional that stays NULL when the condition is NULL."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def safe_log(c: ColumnLike) -> Column:
    """Natural log; NULL for values that have none."""
    return F.when(col(c) > 0, F.log(col(c)))


def recode(c: ColumnLike, mapping: dict[str, str]) -> Column:
    """Replace listed values, keep the others."""
    out = col(c)
    for old, new in mapping.items():
        out = F.when(col(c) == old, F.lit(new)).otherwise(out)
    return out


def level_ordinal(c: ColumnLike, levels: list, reverse: bool = False) -> Column:
    """Position of a value in an explicit level order (0-based); NULL if it is not a level."""
    order = list(reversed(levels)) if reverse else list(levels)
    out = F.lit(None).cast("int")
    for i, level in enumerate(order):
        out = F.when(col(c) == F.lit(level), F.lit(i)).otherwise(out)
    return out


def fold_degrees(c: ColumnLike, period: float = 180.0) -> Column:
    return F.pmod(col(c).cast("double"), F.lit(period))


def polar_endpoint(x: ColumnLike, y: ColumnLike, length: ColumnLike, radians: ColumnLike) -> Column:
    return F.struct(
        (col(x) + col(length) * F.cos(col(radians))).alias("x"),
        (col(y) + col(length) * F.sin(col(radians))).alias("y"),
    )


def next_power_of_two(c: ColumnLike) -> Column:
    """Smallest power of two not below the value."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(col(c)))).cast("long")


def next_power_of_two_int(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(n)))


def near_zero(c: ColumnLike, atol: float = 1e-6) -> Column:
    return F.abs(col(c)) <= atol


# P-value cut points and their labels.
SIGNIFICANCE = [(1e-4, "****"), (1e-3, "***"), (1e-2, "**"), (0.05, "*")]


def significance_stars(p: ColumnLike, hide_ns: bool = False) -> Column:
    out = F.when(col(p).isNull(), F.lit(None).cast("string"))
    for cut, label in SIGNIFICANCE:
        out = out.when(col(p) <= cut, F.lit(label))
    return out.otherwise(F.lit("") if hide_ns else F.lit("ns"))


def milliseconds_label(seconds: ColumnLike) -> Column:
    """0.025 -> '25 ms'."""
    return F.concat(F.format_string("%.0f", col(seconds).cast("double") * 1000), F.lit(" ms"))


def dirname(path: ColumnLike) -> Column:
    """Folder part; an empty string for a bare name."""
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def basename(path: ColumnLike) -> Column:
    return F.substring_index(col(path), "/", -1)
