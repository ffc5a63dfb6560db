"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing and sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonframe.llm import mixing, near, quality, shards, templates
from axonframe.llm.common import stored

SHARDS = 8
PERCENT = 80  # similarity of near duplicates
BANDS = 40  # of 5 rows: a pair at 0.8 misses every band with probability 1e-7


def _whole(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator needs, and the row as it came, so that no column name can clash."""
    return docs.select(*columns, F.struct(*docs.columns).alias("_all"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.ledger(_whole(docs, "text")).filter(quality.passes()).select("_all.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id. Rows without an id stay.

    Rows are named by id and text: of rows that agree in both one stays, different texts of one id are
    judged by their own groups.
    """
    groups = near.near_groups(docs.select("doc_id", "text"), percent=PERCENT, bands=BANDS)
    dropped = stored(groups.filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).distinct(), "pipeline-dropped")
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), digest.alias("_md5"), F.struct(*docs.columns).alias("_all"))
    left = rows.join(dropped.hint("merge"), ["_id", "_md5"], "left_anti")  # one plan at every size
    again = F.row_number().over(Window.partitionBy("_id", "_md5").orderBy(F.lit(0)))
    return left.withColumn("_n", again).filter("_n = 1 OR _id IS NULL").select("_all.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, re-parameterised items included."""
    found = templates.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = stored(found.filter("NOT kept").select(F.col("row").alias("_row")).distinct(), "pipeline-leaks")
    return docs.join(bad, templates.row_key() == F.col("_row"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as whole documents; a document taken twice stands there twice."""
    return mixing.materialise(mixing.mix(_whole(docs, "doc_id", "source", "text"))).select("_all.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its size, shard and slot."""
    return shards.assign(docs, SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

# near-duplicate groups and differencing have no SQL form that runs on whole tables
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
