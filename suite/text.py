"""Log mining on the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonframe.functions import textparse
from axonframe.operators import textlog
from axonframe.sources import files
from suite.base import b, big, num, query, r, table
from suite.surrogates import surrogate, with_


def loglines(spark, sf):
    return surrogate(spark, sf, "loglines")


def reclog(spark, sf):
    return surrogate(spark, sf, "reclog")


CARRY_SQL = (
    "SELECT path, line_no, last_value(CASE WHEN regexp_matches(line, '{p}') THEN trim(line) END IGNORE NULLS)"
    " OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {n} FROM {t}"
)


@query("j5_heading_before_line", with_("loglines", then=CARRY_SQL.format(p="^(## Cell\\d+|## PVneuron-\\d+)", n="cell_id", t="loglines")))
def j5(spark, sf):
    d = textlog.heading_before(loglines(spark, sf), textparse.CELL_HEADING, "cell_id", ["path"], "line_no", "line")
    return d.select("path", "line_no", "cell_id")


@query("j5_slice_before_line", with_("reclog", then=CARRY_SQL.format(p="^(# Slice\\d+)", n="slice_id", t="reclog")))
def j5_slice(spark, sf):
    d = textlog.heading_before(reclog(spark, sf), textparse.SLICE_HEADING, "slice_id", ["path"], "line_no", "line")
    return d.select("path", "line_no", "slice_id")


@query("w16_last_non_null", with_("reclog", then=CARRY_SQL.format(p="started", n="last_start", t="reclog")))
def w16(spark, sf):
    value = F.when(F.col("line").contains("started"), F.trim("line"))
    return textlog.carry_forward(reclog(spark, sf), ["path"], "line_no", value, "last_start").select("path", "line_no", "last_start")


NAMES = ["nicht", "the", "dans", "que", "und"]


@query(
    "j6_first_mention",
    "WITH l AS (SELECT conv_id AS path, turn AS line_no, text AS line FROM conversations),"
    " h AS (SELECT path, name, line_no, line, row_number() OVER (PARTITION BY path, name ORDER BY line_no) AS rn FROM l,"
    f" (SELECT unnest({NAMES!r}) AS name) n WHERE contains(line, name))"
    " SELECT path, name, line_no, trim(list_last(string_split(line, name))) AS after FROM h WHERE rn = 1",
)
def j6(spark, sf):
    lines = table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), F.col("text").alias("line"))
    return textlog.first_lines(lines, NAMES, ["path"], "line_no", "line").select("path", "name", "line_no", "after")


@query(
    "o2_first_hit_by_token",
    with_(
        "reclog",
        names="SELECT DISTINCT concat(CAST(conv_id AS VARCHAR), '_1.abf') AS name FROM conversations",
        h="SELECT path, line_no, regexp_extract(line, '([\\w\\-]+\\.abf)', 1) AS name FROM reclog WHERE contains(line, '.abf')",
        then="SELECT path, name, min(line_no) AS line_no FROM h SEMI JOIN names USING (name) GROUP BY 1, 2",
    ),
)
def o2(spark, sf):
    names = table(spark, sf, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("_1.abf")).alias("name")).distinct()
    d = textlog.first_lines_by_token(reclog(spark, sf), names, textparse.RECORDING_FILE, ["path"], "line_no", "line")
    return d.select("path", "name", "line_no")


@query(
    "f12_recording_starts",
    with_(
        "reclog",
        h="SELECT path, line_no, regexp_extract(line, '([\\w\\-]+\\.abf)', 1) AS name, line FROM reclog WHERE contains(line, '.abf') AND contains(line, 'started') AND NOT contains(line, 'completed')",
        then="SELECT path, name, line_no, trim(replace(concat(name, ': started at ', trim(list_last(string_split(line, name)))), 'started at', '')) AS entry FROM ("
        "SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY line_no DESC) AS rn FROM h) WHERE rn = 1",
    ),
)
def f12(spark, sf):
    return textlog.recording_starts(reclog(spark, sf), ["path"], "line_no", "line").select("path", "name", "line_no", "entry")


@query(
    "f13_filter_entries",
    with_("reclog", then="SELECT path, line_no, line FROM reclog WHERE regexp_matches(line, '_[12]\\.abf started')"),
)
def f13(spark, sf):
    return textlog.entries_matching(reclog(spark, sf), "line", r"_[12]\.abf started").select("path", "line_no", "line")


@query(
    "f14_contains_or_false",
    with_("ei", then=f"SELECT coalesce(contains(region, 'CC'), false) AS hit, {b('count(*)')} AS n FROM ei GROUP BY 1"),
)
def f14(spark, sf):
    d = surrogate(spark, sf, "ei").groupBy(textparse.contains_or_false("region", "CC").alias("hit"))
    return d.agg(big(F.count("*"), "n"))


@query(
    "f15_both_present_line",
    with_("loglines", then="SELECT path, bool_or(line = '## Cell0') AND bool_or(line = '## Cell2') AS both_present FROM loglines GROUP BY 1"),
)
def f15(spark, sf):
    return textlog.both_present(loglines(spark, sf), ["path"], "line", "## Cell0", "## Cell2")


@query(
    "f15_both_present_contains",
    with_("loglines", then="SELECT path, bool_or(contains(line, 'the')) AND bool_or(contains(line, 'Cell')) AS both_present FROM loglines GROUP BY 1"),
)
def f15c(spark, sf):
    return textlog.both_present(loglines(spark, sf), ["path"], "line", "the", "Cell", mode="contains")


@query(
    "o4_last_match_wins",
    with_(
        "reclog",
        h="SELECT path, line_no, regexp_extract(line, '([\\w\\-]+\\.abf)', 1) AS name FROM reclog WHERE contains(line, 'started')",
        then="SELECT path, name, max(line_no) AS line_no FROM h GROUP BY 1, 2",
    ),
)
def o4(spark, sf):
    return textlog.recording_starts(reclog(spark, sf), ["path"], "line_no", "line").select("path", "name", "line_no")


@query(
    "s8_document_lines",
    f"SELECT doc_id, {b('generate_subscripts(string_split(text, chr(10)), 1) - 1')} AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents",
)
def s8(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1))).toDF("doc_id", "line_no", "line")
    return d.select("doc_id", big("line_no", "line_no"), "line")


# --- files written and read back -------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    """A new folder in the shared scratch space; the files are the feature under test here."""
    import uuid

    from axonframe.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(
    "s1_csv_with_differing_headers",
    with_(
        "peaks",
        then=f"SELECT event_id, cell, CASE WHEN event_id % 3 = 0 THEN {r('interval_s')} END AS interval_s, {r('actual_peak')} AS actual_peak, event_id % 3 = 0 AS edited FROM peaks",
    ),
)
def s1(spark, sf):
    d = surrogate(spark, sf, "peaks").select("event_id", "cell", "interval_s", "actual_peak")
    root = _folder(spark, "csv")
    files.write_csv(d.filter("event_id % 3 = 0").select("interval_s", "event_id", "actual_peak", "cell"), f"{root}/merged_mean_peak_edited")
    files.write_csv(d.filter("event_id % 3 <> 0").select("cell", "actual_peak", "event_id"), f"{root}/merged_mean_peak")
    found = [f"{root}/merged_mean_peak_edited", f"{root}/merged_mean_peak"]
    back = files.read_csv_mixed(spark, found, ["event_id", "interval_s", "actual_peak"])
    edited = F.col("source_file").contains("merged_mean_peak_edited")
    return back.select(big("event_id", "event_id"), "cell", num("interval_s", "interval_s"), num("actual_peak", "actual_peak"), edited.alias("edited"))


@query(
    "s1_typed_csv",
    with_("peaks", then=f"SELECT event_id, cell, CASE WHEN event_id % 4 <> 0 THEN {r('interval_s')} END AS interval_s, CASE WHEN event_id % 5 <> 0 THEN {r('actual_peak')} END AS actual_peak FROM peaks"),
)
def s1_typed(spark, sf):
    d = surrogate(spark, sf, "peaks").select(
        "event_id", "cell", F.when(F.col("event_id") % 4 != 0, F.col("interval_s")).alias("interval_s"),
        F.when(F.col("event_id") % 5 != 0, F.col("actual_peak").cast("string")).otherwise("junk").alias("actual_peak"),
    )
    root = _folder(spark, "typed-csv")
    files.write_csv(d, root)  # a missing value is written as NA
    back = files.read_csv_typed(spark, root, "event_id bigint, cell string, interval_s double, actual_peak double")
    return back.select(big("event_id", "event_id"), "cell", num("interval_s", "interval_s"), num("actual_peak", "actual_peak"))


@query("s9_file_catalogue", with_("peaks", then=f"SELECT DISTINCT {b('event_id % 7')} AS part, TRUE AS listed FROM peaks"))
def s9_catalogue(spark, sf):
    root = _folder(spark, "catalogue")
    d = surrogate(spark, sf, "peaks").select((F.col("event_id") % 7).alias("part"), F.col("event_id").cast("string").alias("value"))
    d.write.partitionBy("part").text(root)
    listed = files.catalogue(spark, root, "part-*.txt").filter("length > 0")
    part = F.regexp_extract("path", "/part=(\\d+)/", 1).cast("bigint")
    return files.find_by_pattern(listed, "part-").groupBy(part.alias("part")).agg((F.max("length") > 0).alias("listed"))


@query(
    "s8_log_files",
    with_("reclog", l="SELECT path % 16 AS log, path, line_no, line FROM reclog", then=f"SELECT {b('log')} AS log, {b('row_number() OVER (PARTITION BY log ORDER BY path, line_no) - 1')} AS line_no, line FROM l"),
)
def s8_files(spark, sf):
    root = _folder(spark, "logs")
    d = surrogate(spark, sf, "reclog").withColumn("log", F.col("path") % 16)
    rows = d.repartition(16, "log").sortWithinPartitions("log", "path", "line_no").select("log", F.col("line").alias("value"))
    rows.write.partitionBy("log").text(root)
    back = files.read_log_lines(spark, root)
    return back.select(big(F.regexp_extract("path", r"/log=(\d+)/", 1), "log"), big("line_no", "line_no"), "line")


@query("s10_text_list", f"SELECT '\"' || source || '\",' AS value, {b('count(DISTINCT source)')} AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def s10(spark, sf):
    root = _folder(spark, "list")
    files.write_text_list(table(spark, sf, "documents").filter("source IS NOT NULL"), "source", root)
    return spark.read.text(root).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
