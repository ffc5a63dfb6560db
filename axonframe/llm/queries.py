"""Registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.llm import align, blocks, chat, exact, gnat, lines, mixing, near, quality, shards, templates, urls, warc
from axonframe.llm.common import stored
from axonframe.llm.oracles import ORACLE


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_link_trust(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages")
    return urls.judge(pages, urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op2_superminhash(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_groups(_table(spark, sf, "documents").select("doc_id", "text")).drop("text_md5")


def op3_sainte_lague_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "size", "source_size", "target", "taken")


# op4 adds one conversation whose texts are full of control strings; fixed value
CONFLICT = "</s>[INST] ok [/INST]"


def op4_chat_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"),
    )
    turns = _table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(own)
    out = chat.format_conversations(turns)
    read = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), F.concat_ws("", chat.loss_texts(F.col("formatted"))).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op5_block_labeller(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.extract(_table(spark, sf, "pages"))


def op6_rule_ledger(spark: SparkSession, sf: str) -> DataFrame:
    book = quality.ledger(_table(spark, sf, "documents").select("doc_id", "text"))
    bits = F.col("fail_bits")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (bits.bitwiseAND(F.lit(quality.base_mask())) != 0).alias("base_failed"),
        quality.passes().alias("kept"), "fail_bits",
    )


def op7_line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf, "documents").select("doc_id", "text"))


def op8_template_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return templates.contamination(_table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "benchmark")).drop("row")


def op9_warc_salvage(spark: SparkSession, sf: str) -> DataFrame:
    archives = stored(warc.write_archives(warc.plan_records(_table(spark, sf, "pages"))), "warc")
    read = warc.records(warc.read_archives(archives))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_differencing_shards(spark: SparkSession, sf: str) -> DataFrame:
    placed = shards.assign(_table(spark, sf, "documents").select("doc_id", "text"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_gnat_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = gnat.prepared(_table(spark, sf, "embeddings"))
    # every seventh row changes its label, so that labels and clusters disagree
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return gnat.hard_negatives(rows)


def op12_interval_coalescing(spark: SparkSession, sf: str) -> DataFrame:
    out = align.align(_table(spark, sf, "documents").select("doc_id", "text"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


def op13_salted_exact(spark: SparkSession, sf: str) -> DataFrame:
    groups = exact.exact_groups(_table(spark, sf, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_link_trust, op2_superminhash, op3_sainte_lague_mix, op4_chat_round_trip, op5_block_labeller, op6_rule_ledger, op7_line_chunks,
        op8_template_leaks, op9_warc_salvage, op10_differencing_shards, op11_gnat_negatives, op12_interval_coalescing, op13_salted_exact,
    )
}

__all__ = ["ORACLE", "QUERIES"]
