"""Connected components of masks, on row runs instead of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.operators.attach import attach
from axonframe.session import durable

BLOCK = 64  # pixels
RUN_BITS = 1 << 31  # run id = y * RUN_BITS + start column


def row_runs(masks: DataFrame, value: str = "mask") -> DataFrame:
    """(image_id, rid, y, x0, x1): maximal runs of mask pixels in a row, ends included."""
    at = lambda i: F.coalesce(F.get(F.col(value), i), F.lit(0.0))
    idx = F.sequence(F.lit(0), F.size(value) - 1)
    starts = F.filter(idx, lambda i: (at(i) > 0) & (at(i - 1) <= 0))
    ends = F.filter(idx, lambda i: (at(i) > 0) & (at(i + 1) <= 0))
    runs = masks.filter(F.size(value) > 0).select("image_id", "y", F.inline(F.arrays_zip(starts.alias("x0"), ends.alias("x1"))))
    return runs.toDF("image_id", "y", "x0", "x1").select(
        "image_id", (F.col("y") * RUN_BITS + F.col("x0")).alias("rid"), "y", F.col("x0").cast("bigint").alias("x0"), F.col("x1").cast("bigint").alias("x1")
    )


def run_edges(masks: DataFrame, value: str = "mask") -> DataFrame:
    """(image_id, u, v): touching runs of neighbouring rows, corners included.

    Runs of a row and the next one meet on 64-pixel blocks of the width: a run stands in each block it
    touches (with a pixel of margin), so the join is an equi-join and no row lists all its pairs.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    runs = row_runs(masks, value)
    above = runs.select("image_id", (F.col("y") + 1).alias("y"), F.col("rid").alias("u"), (F.col("x0") - 1).alias("a0"), (F.col("x1") + 1).alias("a1"))
    above = above.withColumn("b", F.explode(F.sequence(block("a0"), block("a1"))))
    below = runs.select("image_id", "y", F.col("rid").alias("v"), "x0", "x1").withColumn("b", F.explode(F.sequence(block("x0"), block("x1"))))
    met = above.join(below, ["image_id", "y", "b"]).filter("x0 <= a1 AND x1 >= a0")
    return met.select("image_id", "u", "v").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star contraction.

    Each node hangs its larger (``large``) or its smaller-or-equal neighbours on the smallest of them.
    """
    if large:
        both = edges.unionByName(edges.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("image_id", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(low, ["image_id", "u"]).filter("v > u")
        return joined.select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = edges.select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("image_id", "u").agg(F.min("v").alias("m"))
    joined = down.join(low, ["image_id", "u"])
    hung = joined.select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return hung.unionByName(low.select("image_id", "u", F.col("m").alias("v"))).distinct()


def connected_runs(masks: DataFrame, value: str = "mask") -> DataFrame:
    """Runs with ``component``, the smallest run id of their 8-connected component.

    Rounds of two joins each until nothing changes; the number of rounds grows with the logarithm of
    the longest chain of runs. Every round is checkpointed.
    """
    edges = durable(run_edges(masks, value))
    signature = None
    while True:
        edges = durable(_star(_star(edges, large=True), large=False))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(38,0)"))).first())
        if now == signature:
            break
        signature = now
    labels = edges.groupBy("image_id", F.col("u").alias("rid")).agg(F.min("v").alias("component"))
    runs = row_runs(masks, value).join(labels, ["image_id", "rid"], "left")
    return runs.withColumn("component", F.coalesce("component", "rid"))


def component_boxes(runs: DataFrame) -> DataFrame:
    """Bounding box (upper ends exclusive) and area of every component."""
    return runs.groupBy("image_id", "component").agg(
        F.min("y").alias("min_row"), F.min("x0").alias("min_col"), (F.max("y") + 1).alias("max_row"),
        (F.max("x1") + 1).alias("max_col"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"),
    )


def largest_component(masks: DataFrame, value: str = "mask") -> DataFrame:
    """Box and area of each image's largest component; of equal ones the first in row-major order."""
    boxes = component_boxes(connected_runs(masks, value))
    best = boxes.groupBy("image_id").agg(
        F.min(F.struct((-F.col("area")).alias("neg"), "component", "min_row", "min_col", "max_row", "max_col")).alias("_b")
    )
    return best.select("image_id", "_b.component", "_b.min_row", "_b.min_col", "_b.max_row", "_b.max_col", (-F.col("_b.neg")).alias("area"))


def keep_component(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Runs that belong to the listed component of each image."""
    return attach(runs, boxes.select("image_id", F.col("component").alias("_c")), ["image_id"], "inner").filter("component = _c").drop("_c")
