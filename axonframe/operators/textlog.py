"""Log mining: headings carried forward, first and last mentions, file-level checks.

All operators take ``(path, line_no, line)`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.functions.textparse import RECORDING_FILE
from axonframe.operators.attach import null_safe_join

CHUNK_LINES = 200_000


def carry_forward(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, chunk_lines: int = CHUNK_LINES
) -> DataFrame:
    """Last non-NULL ``value`` of the rows strictly before each row, per key.

    Files longer than ``chunk_lines`` are cut into pieces; each piece gets the last value of the
    pieces before it from a small summary, so no task holds a whole long file.
    """
    df = df.withColumn("_h", value)
    if not df.filter(F.col(order) >= chunk_lines).limit(1).count():
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(name, F.last("_h", ignorenulls=True).over(w)).drop("_h")
    df = df.withColumn("_piece", F.floor(F.col(order) / chunk_lines))
    pieces = df.groupBy(*keys, "_piece").agg(F.max(F.when(F.col("_h").isNotNull(), F.struct(order, "_h"))).alias("_s"))
    over_pieces = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carried = pieces.select(
        *keys, "_piece", F.last(F.col("_s._h"), ignorenulls=True).over(over_pieces).alias("_carried")
    )
    inside = W.partitionBy(*keys, "_piece").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_local", F.last("_h", ignorenulls=True).over(inside))
    return (
        null_safe_join(local, carried, [*keys, "_piece"], "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_h", "_piece", "_local", "_carried")
    )


def heading_before(
    df: DataFrame, pattern: str, name: str, keys: list[str], order: str, line: str, chunk_lines: int = CHUNK_LINES
) -> DataFrame:
    """Nearest heading line above each line."""
    heading = F.when(F.col(line).rlike(pattern), F.trim(F.col(line)))
    return carry_forward(df, keys, order, heading, name, chunk_lines)


def first_lines(df: DataFrame, names: list[str], keys: list[str], order: str, line: str) -> DataFrame:
    """For each given name the first line of each file that contains it, and the text after the name.

    The names travel inside the scan as one literal array: no join.
    """
    wanted = F.array(*[F.lit(n) for n in names])
    hits = df.select(
        *keys, order, line, F.explode(F.filter(wanted, lambda n: F.col(line).contains(n))).alias("name")
    )
    return _first_hit(hits, keys, order, line)


def first_lines_by_token(
    df: DataFrame, names: DataFrame, pattern: str, keys: list[str], order: str, line: str
) -> DataFrame:
    """As :func:`first_lines` for a long list of names (column ``name``): tokens are cut out of the
    lines and equi-joined."""
    tokens = F.array_distinct(F.regexp_extract_all(F.col(line), F.lit(pattern), F.lit(0)))
    hits = df.select(*keys, order, line, F.explode(tokens).alias("name"))
    return _first_hit(hits, keys, order, line).join(names.select("name").distinct(), "name", "left_semi")


def _first_hit(hits: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    best = hits.groupBy(*keys, "name").agg(F.min(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))).alias("_b"))
    return best.select(
        *keys,
        "name",
        F.col("_b.o").alias(order),
        F.col("_b.l").alias(line),
        F.expr("trim(substring_index(_b.l, name, -1))").alias("after"),
    )


def recording_starts(df: DataFrame, keys: list[str], order: str, line: str, token: str = RECORDING_FILE) -> DataFrame:
    """Recording names on lines that say 'started' and neither 'completed' nor 'aborted'.

    ``entry`` is '<name>: <text after the name>' without 'started at'; the last line wins.
    """
    kept = df.filter(
        F.col(line).contains("started") & ~F.col(line).contains("completed") & ~F.col(line).contains("aborted")
    )
    hits = kept.select(
        *keys, order, line, F.explode(F.regexp_extract_all(F.col(line), F.lit(token), F.lit(1))).alias("name")
    )
    last = hits.groupBy(*keys, "name").agg(F.max(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))).alias("_b"))
    return last.select(
        *keys,
        "name",
        F.col("_b.o").alias(order),
        F.expr(
            "trim(replace(concat(name, ': started at ', trim(substring_index(_b.l, name, -1))), 'started at', ''))"
        ).alias("entry"),
    )


def entries_matching(df: DataFrame, value: str, pattern: str) -> DataFrame:
    return df.filter(F.col(value).rlike(pattern))


def both_present(df: DataFrame, keys: list[str], line: str, a: str, b: str, mode: str = "line") -> DataFrame:
    """Whether both texts occur in a file, as whole lines or (``mode='contains'``) anywhere."""
    if mode not in ("line", "contains"):
        raise ValueError(f"mode must be 'line' or 'contains', not {mode!r}")

    def hit(text: str) -> Column:
        cond = F.col(line) == text if mode == "line" else F.col(line).contains(text)
        return F.coalesce(F.bool_or(cond), F.lit(False))

    return df.groupBy(*keys).agg((hit(a) & hit(b)).alias("both_present"))
