"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: the sources share ``ratio`` times all words by weight; a source above ``most`` times its
   size gives the excess back, which is shared again by weight.
2. Quotas: the mix is cut into blocks of ``block`` words, and the sources get whole blocks by highest
   quotients target / (2k + 1). The same rule deals a source's quota to its shards (hashed parts of a
   bounded number of rows).
3. Selection: the documents of a shard stand in seeded order, their words in blocks. Whole rounds take
   every block; the rest of the quota is a cyclic run of blocks from a seeded start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.llm.common import n_words, stored

BLOCK_WORDS = 16
ROWS_PER_SHARD = 2048
WEIGHTS = (5, 2, 1)  # fixed values: repeated over the sources in code point order
RATIO = (3, 2)  # the mix has 150 % of all words
MOST = 2  # times a source's size


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: tuple[int, int] = RATIO, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Sources stand in code point order, NULL last. With caps ``most * source_size``, the level of the
    shares has a closed form: in ascending order of cap / weight the first sources are capped, the
    rest share what is left. All sums are whole numbers, so the targets do not depend on row order.
    """
    num, den = ratio
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("_r", F.row_number().over(order) - 1)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("_r", F.lit(len(weights))).cast("int")).cast("bigint")
    listed = listed.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * most)
    up = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), "_r")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * num - F.coalesce(F.sum("_cap").over(before), F.lit(0)) * den).cast("double") / (
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))) * den
    )
    # a source is capped while the level of those from it on exceeds its own cap / weight
    leveled = listed.withColumn("_level", level).withColumn("_capped", F.col("_level") * F.col("weight") > F.col("_cap"))
    first = F.min(F.when(~F.col("_capped"), F.struct((F.col("_cap") / F.col("weight")).alias("a"), F.col("_r").alias("b"), F.col("_level").alias("c")))).over(whole)
    return leveled.select("source", "source_size", "weight", F.coalesce(F.least(F.col("_cap").cast("double"), first["c"] * F.col("weight")), F.col("_cap").cast("double")).alias("target"))


def sainte_lague(parties: DataFrame, keys: list[str], seats: Column, votes: str, cap: str, order: list[Column]) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` dealt out within each of ``keys`` by highest votes / (2k + 1).

    A divisor method leaves each share within half the number of parties times its share, plus one, of
    the ideal; only quotients in that range are listed (about three per party in all), the ones below
    are granted. No party gets more than ``cap``; ties go by ``order``.
    """
    group = Window.partitionBy(*keys)
    v = F.col(votes).cast("double")
    base = parties.withColumn("_seats", seats).withColumn("_v", F.sum(v).over(group)).withColumn("_p", F.count(F.lit(1)).over(group))
    share = F.when(F.col("_v") > 0, v / F.col("_v")).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0), F.floor(share * (F.col("_seats") - F.col("_p") / 2) - 1.5)).cast("bigint")
    high = F.ceil(share * (F.col("_seats") + F.col("_p") / 2) + 1.5).cast("bigint")
    base = base.withColumn("_low", F.least(low, F.col(cap))).withColumn("_high", F.greatest(F.least(high, F.col(cap)), F.least(low, F.col(cap))))
    base = base.withColumn("_left", F.col("_seats") - F.sum("_low").over(group))
    names = parties.columns
    steps = base.select("*", F.explode(F.sequence(F.col("_low"), F.col("_high"))).alias("_k"))
    steps = steps.withColumn("_q", F.when(F.col("_k") < F.col("_high"), F.col(votes).cast("double") / (2 * F.col("_k") + 1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_q").desc_nulls_last(), *order, F.col("_k")))
    won = (F.col("_q").isNotNull() & (rank <= F.col("_left"))).cast("bigint")
    return steps.withColumn("_won", won).groupBy(*names, "_low").agg(F.sum("_won").alias("_w")).select(*names, (F.col("_low") + F.col("_w")).alias("quota"))


def _number(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("bigint")


def mix(docs: DataFrame, text: str = "text", seed: int = 7, block: int = BLOCK_WORDS, rows_per_shard: int = ROWS_PER_SHARD, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted).

    NULL texts have no words and are never taken; NULL sources are one source. Repeated rows are
    mixed one by one; ties in the seeded order are between equal rows. Columns of ``docs`` named like
    an added one are replaced; an empty table gives an empty result.
    """
    added = ["size", "source_size", "target", "taken"]
    keep = [c for c in docs.columns if c not in added]
    # a caller's columns travel under numbers, so that no name can clash and unused ones are pruned
    own = {c: f"c{i}" for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], "source", "doc_id", n_words(F.col(text)).alias("size"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")).alias("_h"))
    counted = stored(rows.select("source", "doc_id", "size", "_h"), "mix-sizes")
    shards = max(1, -(-counted.count() // rows_per_shard))
    shard = F.pmod(_number(F.col("_h")), F.lit(shards)).cast("int").alias("_shard")
    parts = stored(counted.groupBy("source", shard).agg(F.sum("size").alias("_tokens"), F.count(F.lit(1)).alias("_rows")), "mix-parts")
    sizes = parts.groupBy("source").agg(F.sum("_tokens").alias("source_size"))
    targets = source_targets(sizes, weights)
    blocks = F.ceil(F.col("_tokens") / block).cast("bigint")
    per_source = parts.groupBy("source").agg(F.sum(MOST * blocks).alias("_cap"))
    wanted = targets.join(per_source, targets["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
    num, den = RATIO
    everything = F.sum("source_size").over(Window.partitionBy())
    seats = F.floor((2 * num * everything + block * den) / (2 * block * den)).cast("bigint")
    quotas = sainte_lague(wanted, [], F.least(seats, F.sum("_cap").over(Window.partitionBy())), "target", "_cap", [F.col("source").asc_nulls_last()])
    # a source at its cap takes every block as often as it may
    full = F.col("target") >= MOST * F.col("source_size")
    quotas = stored(quotas.withColumn("quota", F.when(full, F.col("_cap")).otherwise(F.col("quota"))), "mix-quotas")
    q = quotas.select(F.col("source").alias("_s"), F.col("quota").alias("_of_source"), "source_size", "target")
    dealt = parts.join(q, parts["source"].eqNullSafe(q["_s"])).withColumn("_most", MOST * blocks).drop("_s")
    dealt = stored(sainte_lague(dealt, ["source"], F.col("_of_source"), "_tokens", "_most", [F.col("_shard")]), "mix-shards")
    d = dealt.select(F.col("source").alias("_s"), F.col("_shard").alias("_sh"), "_tokens", "quota", "source_size", "target")
    # the join is on source and shard: a hot source has as many keys as its rows need
    seq = Window.partitionBy("source", "_shard").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_shard", shard).withColumn("_end", F.sum("size").over(seq))
    placed = placed.join(d, placed["source"].eqNullSafe(d["_s"]) & (F.col("_shard") == F.col("_sh"))).drop("source", "doc_id")
    nb = F.greatest(F.ceil(F.col("_tokens") / block), F.lit(1)).cast("bigint")
    start = F.pmod(_number(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_sh").cast("string"), F.col("_s")).cast("binary"))), nb)
    placed = placed.withColumn("_nb", nb).withColumn("_first", start).withColumn("_extra", F.pmod("quota", F.col("_nb"))).withColumn("_rounds", F.floor(F.col("quota") / F.col("_nb")).cast("bigint"))
    begin = F.col("_end") - F.col("size")
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("_end"), hi) - F.greatest(begin, lo))
    stop = F.col("_first") + F.col("_extra")
    run = overlap(F.col("_first") * block, F.least(stop, F.col("_nb")) * block) + overlap(F.lit(0), F.greatest(stop - F.col("_nb"), F.lit(0)) * block)
    taken = (F.col("_rounds") * F.col("size") + run).cast("bigint")
    return placed.select(*[F.col(n).alias(c) for c, n in own.items()], "size", "source_size", "target", taken.alias("taken"))


def materialise(mixed: DataFrame) -> DataFrame:
    """The mix as whole documents: a row appears as often as its taken words fill it, to the nearest
    whole number. Only the documents at the ends of the runs are ever rounded, two per shard."""
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    return mixed.select(F.struct(*mixed.columns).alias("doc"), F.explode(F.array_repeat(F.lit(1), copies))).select("doc.*")
