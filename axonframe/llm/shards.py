"""Balanced shards by Karmarkar-Karp differencing over indivisible groups of equal texts.

Groups of at least ``1 / bins`` of all bytes (at most ``bins`` of them can exist) are items of their
own; all smaller groups are packed whole into ``bins`` hash bins. So differencing sees at most
``2 * bins`` items whatever the size of the corpus, and no group is ever cut.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.llm.common import stored

BINS = 4096
ROWS_PER_CHUNK = 2048


def differencing(sizes: list[int], k: int) -> list[int]:
    """Shard of every item: the largest-spread partial partitions are merged first, the fullest part of
    one with the emptiest of the other. Ties go by item order, so reruns agree."""
    heap = []
    for i, s in enumerate(sizes):
        parts = [(0, ())] * (k - 1) + [(s, (i,))]
        heap.append((-s, i, parts))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # members are kept as nested pairs, so a merge costs k steps and not the size of the parts
        merged = sorted(((x[0] + y[0], (x[1], y[1])) for x, y in zip(a, reversed(b))), key=lambda p: p[0])
        least = merged[0][0]
        merged = [(s - least, m) for s, m in merged]
        heapq.heappush(heap, (-merged[-1][0], order, merged))
        order += 1
    shard = [0] * len(sizes)
    if heap:
        for at, (_, members) in enumerate(heap[0][2]):
            stack = [members]
            while stack:
                m = stack.pop()
                if len(m) == 1:
                    shard[m[0]] = at
                else:
                    stack.extend(m)
    return shard


def _place(k: int):
    def run(batches):
        items = pd.concat([*batches, pd.DataFrame({"item": [], "size": []}, dtype="int64")]).sort_values("item")
        yield pd.DataFrame({"item": items["item"], "shard": differencing([int(s) for s in items["size"]], k)}).astype({"item": "int64", "shard": "int32"})

    return run


def assign(docs: DataFrame, shards: int = 8, text: str = "text", bins: int = BINS, size: Column | None = None) -> DataFrame:
    """(all columns of ``docs``, size, text_crc32, shard, slot): one row per row of ``docs``.

    ``size`` is the UTF-8 length of the text plus 1 unless given; NULL texts count as empty and form one
    group with empty ones. Equal texts share a shard. ``slot`` numbers the rows of a shard from 0 without
    gaps, by hashed chunks and then by id, so no task numbers a whole shard. Columns of ``docs`` named
    like an added one are replaced; an empty table gives an empty result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    added = ["size", "text_crc32", "shard", "slot"]
    keep = [c for c in docs.columns if c not in added]
    doc_id = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("bigint")
    weighed = docs.select(F.struct(*keep).alias("doc"), (F.octet_length(t) + 1 if size is None else size).cast("bigint").alias("size"), F.crc32(t.cast("binary")).cast("bigint").alias("text_crc32"), F.unhex(F.md5(t.cast("binary"))).alias("_key"), doc_id.alias("_id"))
    narrow = stored(weighed.select("_key", "size"), "shard-sizes")
    total = narrow.agg(F.sum("size"), F.count(F.lit(1))).first()
    least = max(1, -(-(total[0] or 0) // bins))
    groups = narrow.groupBy("_key").agg(F.sum("size").alias("size"))
    # at most `bins` groups can hold 1 / bins of the bytes each: a proven bound for the broadcast
    big = stored(groups.filter(F.col("size") >= least).select("_key", F.lit(True).alias("_big")), "shard-groups")
    bin_of = F.pmod(F.xxhash64("_key"), F.lit(bins)).cast("bigint")
    own = F.xxhash64("_key").bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))
    item = F.when(F.col("_big"), own).otherwise(bin_of).alias("item")
    items = narrow.join(F.broadcast(big), "_key", "left").select(item, "size").groupBy("item").agg(F.sum("size").alias("size"))
    placed = stored(items.coalesce(1).mapInPandas(_place(shards), "item bigint, shard int"), "shard-items")  # at most 2 * bins rows
    chunks = max(1, -(-(total[1] or 0) // (shards * ROWS_PER_CHUNK)))
    rows = weighed.join(F.broadcast(big), "_key", "left").withColumn("item", item).join(F.broadcast(placed), "item")
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("_id", "_key"), F.lit(chunks)).cast("int"))
    here = rows.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = here.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_chunk").orderBy("_id", "text_crc32", "size")
    numbered = rows.withColumn("_at", F.row_number().over(inside) - 1).join(starts, ["shard", "_chunk"])
    return numbered.select("doc.*", "size", "text_crc32", "shard", (F.col("_start") + F.col("_at")).cast("bigint").alias("slot"))
