"""File catalogue, CSV and log readers and writers."""

from __future__ import annotations

import csv as csv_module
import re
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from axonframe.functions.scalar import basename, dirname
from axonframe.operators.clean import to_numeric
from axonframe.operators.reshape import bind_rows

# Names of the data files.
PEAK_FILE = "merged_mean_peak.csv"
PEAK_FILE_EDITED = "merged_mean_peak_edited.csv"
DATED_CSV = r"^\d{4}\.\d{2}\.\d{2}\.csv"
JPG = r"(?i).*\.jpg$"


def catalogue(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, modified) of all files below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def find_by_name(files: DataFrame, name: str) -> DataFrame:
    """First path (in path order) with exactly this file name."""
    return files.filter(basename("path") == name).agg(F.min("path").alias("path")).filter("path IS NOT NULL")


def find_by_pattern(files: DataFrame, pattern: str) -> DataFrame:
    """Paths whose file name matches from its start."""
    return files.filter(basename("path").rlike(pattern if pattern.startswith(("^", "(?i)")) else "^" + pattern))


def siblings(anchor: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """Files next to each anchor path whose name matches ``pattern``."""
    left = anchor.select(F.col("path").alias("anchor"), dirname("path").alias("dir"))
    right = find_by_pattern(files, pattern).select(F.col("path").alias("sibling"), dirname("path").alias("dir"))
    return left.join(right, "dir").select("anchor", "sibling")


def one_per_folder(files: DataFrame) -> DataFrame:
    """One peak file per folder; an edited one wins."""
    edited = F.col("path").rlike(r"_edited\.csv$")
    best = files.groupBy(dirname("path").alias("dir")).agg(
        F.min(F.struct(F.when(edited, 0).otherwise(1).alias("rank"), F.col("path").alias("path"))).alias("_b")
    )
    return best.select("dir", F.col("_b.path").alias("path"))


def prefer_edited(files: DataFrame) -> DataFrame:
    """Plain peak files, each replaced by its edited sibling if there is one.

    A folder that only holds an edited file yields nothing (see :func:`one_per_folder`).
    """
    return (
        files.filter(basename("path").isin(PEAK_FILE, PEAK_FILE_EDITED))
        .groupBy(dirname("path").alias("dir"))
        .agg(
            F.max(F.when(basename("path") == PEAK_FILE, F.col("path"))).alias("_plain"),
            F.max(F.when(basename("path") == PEAK_FILE_EDITED, F.col("path"))).alias("_edited"),
        )
        .filter("_plain IS NOT NULL")
        .select("dir", F.coalesce("_edited", "_plain").alias("path"))
    )


def keep_existing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    return wanted.join(files.select("path"), "path", "left_semi")


def path_keys(df: DataFrame, path: str = "path") -> DataFrame:
    """animal, region, area of ``.../{animal}/{region}/{area}.tif`` and the id after the last '_'."""
    pattern = r"([^/]+)/([^/]+)/([^/]+)\.[^./]+$"
    stem = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    return df.select(
        "*",
        *[F.nullif(F.regexp_extract(path, pattern, i), F.lit("")).alias(n) for i, n in enumerate(("animal", "region", "area"), 1)],
        F.substring_index(stem, "_", -1).alias("id"),
    )


def read_csv_typed(spark: SparkSession, paths: str | list[str], schema: StructType | str) -> DataFrame:
    """CSV with a header and a declared schema; 'NA' is NULL, unreadable numbers too."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "NA")
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", True)
        .csv(paths)
    )


HEAD_BYTES = 1 << 16


def _first_line(path: str) -> str | None:
    """The first line of a file; only as much is read as it takes."""
    from pyarrow import fs

    kind, at = fs.FileSystem.from_uri(quote(re.sub(r"^file:/(?!/)", "file:///", path), safe=":/@"))
    with kind.open_input_file(at) as f:
        data, n = b"", HEAD_BYTES
        while b"\n" not in data:
            more = f.read(n)
            if not more:
                break
            data, n = data + more, 2 * n
    return data.split(b"\n", 1)[0].rstrip(b"\r").decode(errors="replace") if data else None


def _first_lines(batches):
    import pyarrow as pa

    for batch in batches:
        paths = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([_first_line(p) for p in paths], pa.string())], ["path", "value"])


def head_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, value): the first line of every file that has one. The bytes read do not grow with the files.

    Files are listed by Spark and opened in its tasks, by Arrow's file systems (local, HDFS, S3, GCS).
    """
    listed = spark.read.format("binaryFile").load(paths).select("path")  # the content is not read
    return listed.mapInArrow(_first_lines, "path string, value string").filter("value IS NOT NULL")


def _headers(spark: SparkSession, paths: list[str]) -> list[tuple[str, list[str]]]:
    """Distinct header lines with their files."""
    grouped = head_lines(spark, paths).groupBy("value").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("value")
    return [(r["value"], r["paths"]) for r in grouped.collect()]


def read_csv_mixed(spark: SparkSession, paths: list[str], numeric: list[str] | None = None) -> DataFrame:
    """Files with different headers, bound by column name; every column is text until cast.

    Files are grouped by header line and each group is read once. ``source_file`` and ``ordinal``
    (block start, then row within the block) give the position in the file.
    """
    parts = []
    for header, group in _headers(spark, paths):
        names = next(csv_module.reader([header.lstrip("﻿")]))
        names = [n if n else f"...{i}" for i, n in enumerate(names, 1)]
        schema = StructType([StructField(n, StringType()) for n in names])
        part = spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(group)
        parts.append(
            part.select(
                "*",
                F.col("_metadata.file_path").alias("source_file"),
                F.struct(
                    F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
                ).alias("ordinal"),
            )
        )
    out = bind_rows(*parts)
    return to_numeric(out, numeric) if numeric else out


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def write_text_list(df: DataFrame, col: str, path: str, mode: str = "errorifexists") -> None:
    """Distinct values of a column as quoted text lines."""
    df.select(F.format_string('"%s",', F.col(col)).alias("value")).distinct().write.mode(mode).text(path)


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line_no, line) of UTF-8 logs of any size.

    Files are read in splits. A line's number is its position in the split plus the lines of the
    splits before it; only one row per split is needed for that.
    """
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_id"),
            F.col("value").alias("line"),
        )
    )
    blocks = raw.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select(
        "path", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return raw.join(starts, ["path", "_block"]).select(
        "path", (F.col("_start") + F.col("_id") - F.col("_first")).alias("line_no"), "line"
    )


def read_log_lines_any_charset(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """As :func:`read_log_lines` for small logs (each fits in one row) of unknown encoding:
    UTF-16 with a byte-order mark, else UTF-8 if valid, else Latin-1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    mark = F.hex(F.substring("content", 1, 2))
    text = (
        F.when(mark.isin("FFFE", "FEFF"), F.decode("content", "UTF-16"))
        .when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
        .otherwise(F.decode("content", "ISO-8859-1"))
    )
    return raw.select("path", F.posexplode(F.split(text, "\n"))).toDF("path", "line_no", "line")
