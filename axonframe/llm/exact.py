"""Exact duplicates by skew-safe combining.

1. A narrow table names every row by a digest of its normalised text (white space deleted).
2. Digests that hold at least ``1 / HOT`` of the rows (at most ``HOT`` can) get salts, one per map task
   modulo ``SALTS``; all others have one salt.
3. Rows are combined by digest, salt and *content*: Spark's partial aggregate keeps one row per content
   in every map task (local deduplication), and the shuffle merges what is left of each salted group.
4. The winners of the salts of a hot digest are combined by digest and content once more.

Content is part of every group's key, so two texts of one digest never become one group. If that ever
happens, the rows of that digest find their group by content instead of by digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import BLANKS, stored

HOT = 4096
SALTS = 64
_SPAN = 1 << 65  # room for an id in a score


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; NULL counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _whole(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(20,0)")


def _score() -> Column:
    """Code points first, then the smaller id (NULL last), in one number that a hash aggregate can keep."""
    before = F.coalesce(_whole(1 << 63) - F.col("doc_id").cast("decimal(20,0)"), _whole(0))
    return (F.col("chars").cast("decimal(10,0)") * _whole(_SPAN) + before).cast("decimal(38,0)")


def _id_of(score: Column) -> Column:
    before = (score % _whole(_SPAN)).cast("decimal(20,0)")
    return F.when(before > 0, (_whole(1 << 63) - before).cast("bigint"))


def _combined(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max("score").alias("score"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, n_chars) per row of ``docs`` (doc_id, text).

    Rows are equal when their normalised texts are. The row with the most code points in its original
    text stays, of equally long ones that with the smallest ``doc_id``; a NULL id comes after all others,
    and of rows that agree in both any single one stays. NULL and empty texts and texts of blanks alone
    are one group. ``digest`` maps a normalised text to its binary digest; it may collide. Other
    columns are ignored; an empty table gives an empty result.
    """
    norm = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("chars"), norm.alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    narrow = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "chars", "digest"), "exact-rows")
    sizes = narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    least = max(2, -(-narrow.count() // hot))
    # at most `hot` digests can hold 1 / hot of the rows each: a proven bound for the broadcasts
    hottest = stored(sizes.filter(F.col("n") >= least).select("digest", F.lit(True).alias("hot")), "exact-hot")
    dealt = rows.join(F.broadcast(hottest), "digest", "left").select(
        "digest", "norm", _score().alias("score"), F.lit(1).cast("bigint").alias("n"), F.when(F.col("hot"), F.spark_partition_id() % salts).otherwise(-1).alias("salt")
    )
    merged = _combined(dealt, "digest", "salt", "norm").select("digest", "salt", F.when(F.col("salt") >= 0, F.col("norm")).alias("norm"), "score", "n")
    merged = stored(merged, "exact-salts")
    winners = _combined(merged.filter("salt >= 0"), "digest", "norm").unionByName(merged.filter("salt < 0").select("digest", "norm", "score", "n")).select("digest", "score", "n")
    winners = stored(winners, "exact-winners")
    twice = stored(winners.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("digest"), "exact-collisions")
    collided = not twice.isEmpty()
    left, best = narrow, winners
    if collided:  # texts that share a digest are told apart by content
        left, best = (x.join(twice, "digest", "left_anti") for x in (narrow, winners))
    warm = F.broadcast(hottest.select("digest"))
    one = left.join(warm, "digest", "left_anti").join(best.join(warm, "digest", "left_anti").hint("merge"), "digest")
    found = one.unionByName(left.join(F.broadcast(best.join(warm, "digest", "left_semi")), "digest"))
    return _decided(found.unionByName(_by_content(rows, twice)) if collided else found)


def _by_content(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """Rows of digests with several contents, with the score and size of their own content."""
    part = rows.join(twice, "digest", "left_semi").select(F.monotonically_increasing_id().alias("row"), "doc_id", "chars", "digest", "norm")
    part = stored(part, "exact-collided")
    best = _combined(part.select("digest", "norm", _score().alias("score"), F.lit(1).cast("bigint").alias("n")), "digest", "norm")
    return part.join(best, ["digest", "norm"]).select("row", "doc_id", "chars", "digest", "score", "n")


def _decided(found: DataFrame) -> DataFrame:
    """The winner of every row; of rows that agree with it in length and id the first one stays."""
    rows = stored(found.select("row", "doc_id", "chars", "digest", "n", "score", (_score() == F.col("score")).alias("kept")), "exact-decided")
    best = rows.filter("kept")
    again = best.groupBy("digest", "score").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("digest", "score", "first")
    best = best.join(again, ["digest", "score"], "left").withColumn("kept", F.coalesce(F.col("first") == F.col("row"), F.lit(True)))
    out = rows.filter("NOT kept").unionByName(best.select(*rows.columns))
    return out.select("doc_id", _id_of(F.col("score")).alias("keep_id"), F.col("n").alias("group_size"), "kept", "digest", F.col("chars").cast("bigint").alias("n_chars"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they came; see :func:`exact_groups`."""

    def key(digest: Column, chars: Column) -> list[Column]:
        i = F.col("doc_id").cast("bigint")
        return [digest.alias("k_digest"), chars.cast("bigint").alias("k_chars"), F.coalesce(i, F.lit(0)).alias("k_id"), i.isNull().alias("k_null")]

    text = F.col("text").cast("string")
    stay = exact_groups(docs).filter("kept").select(*key(F.col("digest"), F.col("n_chars")))
    names = stay.columns
    whole = docs.select(*key(sha256(normalised(text)), F.length(F.coalesce(text, F.lit("")))), F.struct(*docs.columns).alias("whole"))
    return whole.join(stay.hint("merge"), names, "left_semi").dropDuplicates(names).select("whole.*")
