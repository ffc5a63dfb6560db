"""The given tables seen as recordings, peaks, regions of interest, logs, files and images.

Each surrogate is a list of ``expression AS name`` texts that Spark and DuckDB both read, so the
query and its SQL start from the same data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suite.base import table

EI = [
    "l_orderkey AS filename_plus10",
    "l_partkey AS filename_minus55",
    "CASE WHEN l_linestatus = 'O' THEN 'blue' ELSE 'red' END AS color",
    "CASE WHEN l_shipdate < TIMESTAMP '1995-01-01 00:00:00' THEN 'ChR2' ELSE 'ChrimsonR' END AS opsin",
    "CASE WHEN l_returnflag = 'A' THEN 'ACC' WHEN l_returnflag = 'R' THEN 'RSC' END AS region",
    "l_suppkey AS brain_id",
    "l_linenumber AS slice_id",
    "l_partkey % 4 AS cell_id",
    "-2.4e0 * l_quantity AS amp_minus55",
    "CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / 1000e0 END AS amp_plus10",
    "CASE WHEN l_discount = 0 THEN NULL ELSE -2.4e0 - 24e0 * l_discount END AS rough_ap",
    "CASE WHEN l_discount < 0.05e0 THEN 'anterior' ELSE 'posterior' END AS ap_region",
    "l_linenumber AS stim_duration",
    "CASE WHEN l_quantity > 25 THEN 100 ELSE 50 END AS stim_power",
    "l_suppkey AS o1",
    "l_linenumber AS o2",
    "l_extendedprice AS o3",
]
EI_ORDINAL = ["o1", "o2", "o3"]

PEAKS = [
    "event_id",
    "CAST(user_id AS STRING) AS cell",
    "CASE event_type WHEN 'click' THEN 0e0 WHEN 'view' THEN 0.025e0 WHEN 'purchase' THEN 0.05e0"
    " WHEN 'signup' THEN 0.1e0 ELSE 0.25e0 END AS interval_s",
    "value AS actual_peak",
    "1e0 + event_id % 17 AS estimated_peak",
    "CASE WHEN event_id % 19 = 0 THEN NULL ELSE value / 2e0 END AS first_peak",
    "2e0 + event_id % 11 AS third_peak",
    "CASE WHEN user_id % 2 = 0 THEN 'Cs' ELSE 'K' END AS intra",
    "concat(CASE WHEN user_id % 3 = 0 THEN 'R_2 A ' ELSE 'R_1 A ' END, CAST(user_id % 100 AS STRING), '% 5 ms B_2 A ',"
    " CAST(user_id % 40 AS STRING), '.5% 2.5 ms IT_', CAST(event_id % 200 AS STRING), ' ms ',"
    " CASE WHEN event_id % 7 = 0 THEN '-55 mV' ELSE '-75 mV' END,"
    " CASE event_id % 4 WHEN 2 THEN ' ptx 25 uM' WHEN 3 THEN ' 4-AP 3 mM' ELSE '' END,"
    " CASE WHEN event_id % 9 = 0 THEN ' RMP -68 mV' ELSE '' END) AS log",
]
INTERVALS = [0.0, 0.025, 0.05, 0.1, 0.25]

ROI = [
    "event_id",
    "event_type AS region",
    "user_id AS mouse_id",
    "CASE WHEN event_id % 2 = 0 THEN 'altitude' ELSE 'azimuth' END AS axis",
    "event_id % 30 AS roi_id",
    "value AS mean",
]

LOGLINES = [
    "conv_id AS path",
    "turn AS line_no",
    "role",
    "CASE WHEN role = 'user' THEN concat('## Cell', CAST(turn AS STRING)) ELSE text END AS line",
]

# A log per conversation: every assistant turn names a recording and says what happened to it.
RECLOG = [
    "conv_id AS path",
    "turn AS line_no",
    "CASE WHEN role = 'user' THEN concat('# Slice', CAST(turn AS STRING))"
    " ELSE concat('rec ', CAST(conv_id AS STRING), '_', CAST(turn % 3 AS STRING), '.abf',"
    " CASE turn % 4 WHEN 0 THEN ' completed' ELSE ' started at ' END, CAST(length(text) AS STRING), ' ') END AS line",
]

FILES = [
    "concat('/d', CAST(CAST(floor(p_partkey / 2e0) AS BIGINT) AS STRING), '/merged_mean_peak',"
    " CASE WHEN p_size > 35 THEN '_edited' ELSE '' END, '.csv') AS path",
]

SOURCES = {
    "ei": (EI, "lineitem"),
    "peaks": (PEAKS, "events"),
    "roi": (ROI, "events"),
    "loglines": (LOGLINES, "conversations"),
    "reclog": (RECLOG, "conversations"),
}

IMAGE_ROWS = 64  # rows per image: every vector is one image row

SQL = {name: f"{name} AS (SELECT {', '.join(exprs)} FROM {src})" for name, (exprs, src) in SOURCES.items()}
SQL["files"] = f"files AS (SELECT DISTINCT {FILES[0]} FROM part)"
SQL["px"] = (
    "px AS (SELECT image_id, y, x, CAST(floor(128 * (1 + CAST(v AS DOUBLE))) AS DOUBLE) AS v, v > 0 AS m,"
    " (floor(x / 8e0) + floor(y / 8e0)) % 2 = 0 AS patch FROM ("
    f" SELECT CAST(floor(vec_id / {IMAGE_ROWS}e0) AS BIGINT) AS image_id, CAST(vec_id % {IMAGE_ROWS} AS BIGINT) AS y,"
    " unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS x FROM embeddings))"
)


def with_(*names: str, then: str, **ctes: str) -> str:
    """WITH clause of the named surrogates and further CTEs, followed by a query."""
    parts = [SQL[n] for n in names] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return "WITH " + ", ".join(parts) + " " + then


def surrogate(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name == "files":
        return table(spark, sf, "part").selectExpr(*FILES).distinct()
    exprs, src = SOURCES[name]
    return table(spark, sf, src).selectExpr(*exprs)


def strips(spark: SparkSession, sf: str) -> DataFrame:
    """Images as row strips: (image_id, y, pixels, mask)."""
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / F.lit(float(IMAGE_ROWS))).cast("bigint").alias("image_id"),
        (F.col("vec_id") % IMAGE_ROWS).alias("y"),
        F.transform("embedding", lambda v: F.floor(128 * (1 + v.cast("double"))).cast("double")).alias("pixels"),
        F.transform("embedding", lambda v: F.when(v > 0, 1.0).otherwise(0.0)).alias("mask"),
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Images as pixels: (image_id, y, x, v, m, patch)."""
    raw = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / F.lit(float(IMAGE_ROWS))).cast("bigint").alias("image_id"),
        (F.col("vec_id") % IMAGE_ROWS).alias("y"),
        F.posexplode("embedding").alias("x", "e"),
    )
    return raw.select(
        "image_id", "y", F.col("x").cast("bigint").alias("x"),
        F.floor(128 * (1 + F.col("e").cast("double"))).cast("double").alias("v"),
        (F.col("e") > 0).alias("m"),
        ((F.floor(F.col("x") / 8.0) + F.floor(F.col("y") / 8.0)) % 2 == 0).alias("patch"),
    )
