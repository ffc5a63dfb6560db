"""Line dedup on content-defined chunks of lines.

Only neighbouring lines that stand together more than once in the corpus can belong to a repeated passage, so
a run goes on as long as each pair of neighbours is repeated. Inside a run, rolling hashes over two lines set
the boundaries: a line ends a chunk if the hash of it and the line before is the smaller one of two neighbouring
hashes. That depends on the lines alone, leaves no three of them without a boundary, and so cuts a passage alike
wherever it stands, whatever repeated lines are next to it. A long line stands alone. Chunks with equal hashes
are those of their first occurrence; from a repeated chunk the match is carried on line by line to both
sides against the same first occurrence, so that the edges of a passage are found too. All of it is compared
byte by byte, and what is left in spans of enough words is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.llm.common import n_words, stored

LONG_WORDS = 50  # a line of so many words is a passage by itself
LEAST_WORDS = 20  # removed spans have at least so many words
_DOC = ("k1", "k2")
_FIRST = ("o1", "o2", "at_o")


def _key(doc_id: Column, text: Column) -> list[Column]:
    """Key of a row by its id and text; rows with equal keys are equal for this operator."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(doc_id, t).alias("k1"), F.xxhash64(t, doc_id, F.lit("line")).alias("k2")]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def run_table(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(k1, k2, doc_id, run, pos, h, w, ends): lines of repeated runs, and whether a chunk ends after them."""
    one = lambda line: F.struct(F.xxhash64(line).alias("h"), n_words(line).alias("w"))
    per_doc = docs.select(*_key(F.col("doc_id"), F.col("text")), "doc_id", F.transform(_lines(F.col("text")), one).alias("l")).dropDuplicates([*_DOC])
    per_doc = stored(per_doc, "line-hashes")
    # a pair is named by its second line; a long line alone as well
    pair = F.transform("l", lambda x, i: F.struct(i.alias("pos"), F.xxhash64(F.get("l", i - 1)["h"], x["h"]).alias("g"), F.get("l", i - 1).alias("before"), x.alias("x")))
    pair = F.filter(pair, lambda p: (p["pos"] > 0) & ((p["x"]["w"] > 0) | (p["before"]["w"] > 0)))
    alone = F.transform("l", lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x["h"], F.lit("long")).alias("g"), F.lit(None).cast("struct<h:bigint,w:bigint>").alias("before"), x.alias("x")))
    alone = F.filter(alone, lambda p: p["x"]["w"] >= long_words)
    marks = per_doc.select(*_DOC, "doc_id", F.explode(F.concat(pair, alone)).alias("p")).select(*_DOC, "doc_id", "p.*")
    often = marks.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g")
    again = marks.join(often, "g")
    by_doc = Window.partitionBy(*_DOC).orderBy("pos")
    pairs = again.filter("before IS NOT NULL").withColumn("_new", F.coalesce(F.col("pos") - F.lag("pos").over(by_doc) != 1, F.lit(True)))
    pairs = pairs.withColumn("run", F.sum(F.col("_new").cast("int")).over(by_doc))
    by_run = Window.partitionBy(*_DOC, "run").orderBy("pos")
    smaller = lambda other: F.coalesce(F.col("g") <= other, F.lit(False))
    pairs = pairs.withColumn("ends", smaller(F.lag("g").over(by_run)) | smaller(F.lead("g").over(by_run)))
    # the first pair of a run brings its first line along
    line = lambda pos, x, ends: F.struct(pos.alias("pos"), x["h"].alias("h"), x["w"].alias("w"), ends.alias("ends"))
    own = line(F.col("pos"), F.col("x"), F.col("ends"))
    both = F.when(F.col("_new"), F.array(line(F.col("pos") - 1, F.col("before"), F.lit(False)), own)).otherwise(F.array(own))
    lines = pairs.select(*_DOC, "doc_id", "run", F.explode(both).alias("y")).select(*_DOC, "doc_id", "run", "y.*")
    single = again.filter("before IS NULL").select(*_DOC, "doc_id", (-F.col("pos") - 1).alias("run"), "pos", "x.h", "x.w", F.lit(True).alias("ends"))
    return stored(lines.unionByName(single), "line-runs")


def chunk_table(lines: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(k1, k2, doc_id, run, at, lines, words, chunk): chunks of the runs, by place and hash."""
    by_run = Window.partitionBy(*_DOC, "run").orderBy("pos")
    long = F.col("w") >= long_words
    starts = long | F.coalesce(F.lag(F.col("ends") | long).over(by_run), F.lit(True))
    marked = lines.withColumn("c", F.sum(starts.cast("int")).over(by_run))
    hashes = F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"])
    return marked.groupBy(*_DOC, "run", "c").agg(
        F.first("doc_id").alias("doc_id"), F.min("pos").alias("at"), F.count(F.lit(1)).cast("int").alias("lines"), F.sum("w").alias("words"), F.xxhash64(hashes).alias("chunk")
    ).drop("c")


def _carried_on(lines: DataFrame, late: DataFrame) -> DataFrame:
    """Lines next to repeated chunks that equal the lines next to the chunks' first occurrences."""
    inside = late.select(*_DOC, "run", F.explode(F.sequence("at", F.col("at") + F.col("lines") - 1)).alias("pos"), "o1", "o2", (F.col("at") - F.col("at_o")).alias("shift"))
    runs = lines.join(late.select(*_DOC, "run").distinct(), [*_DOC, "run"], "left_semi")
    rows = runs.join(inside, [*_DOC, "run", "pos"], "left")
    by_run = Window.partitionBy(*_DOC, "run").orderBy("pos")
    anchor = F.when(F.col("shift").isNotNull(), F.struct("o1", "o2", "shift", F.col("pos").alias("from")))
    left = F.last(anchor, ignorenulls=True).over(by_run.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(anchor, ignorenulls=True).over(by_run.rowsBetween(0, Window.unboundedFollowing))
    open_ = rows.withColumn("sides", F.array(left, right)).filter("shift IS NULL")
    open_ = open_.select(*_DOC, "run", "pos", "h", "w", F.explode(F.filter("sides", lambda a: a.isNotNull())).alias("a"))
    asked = open_.select(*_DOC, "run", "pos", "h", "w", "a.o1", "a.o2", (F.col("pos") - F.col("a.shift")).alias("at_o"), F.col("a.from").alias("from"))
    there = lines.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("pos").alias("at_o"), "h", F.lit(True).alias("found")).distinct()
    met = asked.join(there, ["o1", "o2", "at_o", "h"], "left")
    # a line counts if all lines between it and the chunk do
    outward = Window.partitionBy(*_DOC, "run", "from", F.col("pos") > F.col("from")).orderBy(F.abs(F.col("pos") - F.col("from")))
    met = met.withColumn("_missed", F.sum(F.col("found").isNull().cast("int")).over(outward)).filter("_missed = 0")
    first = F.min(F.struct("o1", "o2", "at_o")).alias("o")
    return met.groupBy(*_DOC, "run", "pos").agg(first, F.first("w").alias("words")).select(*_DOC, "run", F.col("pos").alias("at"), F.lit(1).alias("lines"), "words", "o.*")


def _with_spans(rows: DataFrame) -> DataFrame:
    """Number neighbouring pieces of a document alike in ``_s``."""
    by_doc = Window.partitionBy(*_DOC).orderBy("at")
    new = F.coalesce(F.col("at") != F.lag(F.col("at") + F.col("lines")).over(by_doc), F.lit(True))
    return rows.withColumn("_new", new).withColumn("_s", F.sum(F.col("_new").cast("int")).over(by_doc)).drop("_new")


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(k1, k2, at, lines, words): what repeats an earlier place byte by byte (earlier: by doc_id, NULL first, then place).

    Only spans of at least ``least_words`` words, and the places they repeat, have their bytes fetched.
    """
    lines = run_table(docs, long_words)
    # a long line may stand in a run and alone
    chunks = chunk_table(lines, long_words).groupBy(*_DOC, "at", "lines").agg(F.max("run").alias("run"), F.first("doc_id").alias("doc_id"), F.first("words").alias("words"), F.first("chunk").alias("chunk"))
    place = F.struct("doc_id", "k1", "k2", "at")
    first = chunks.groupBy("chunk").agg(F.min(place).alias("o"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk", "o")
    late = chunks.join(first, "chunk").filter(place != F.col("o")).select(*_DOC, "run", "at", "lines", "words", F.col("o.k1").alias("o1"), F.col("o.k2").alias("o2"), F.col("o.at").alias("at_o"))
    late = stored(late, "line-late")
    pieces = _with_spans(late.unionByName(_carried_on(lines, late)))
    pieces = pieces.withColumn("_w", F.sum("words").over(Window.partitionBy(*_DOC, "_s"))).filter(F.col("_w") >= least_words)
    pieces = stored(pieces.select(*_DOC, "at", "lines", "words", *_FIRST), "line-pieces")
    wanted = pieces.select(*_DOC, "at", "lines").unionByName(pieces.select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), F.col("at_o").alias("at"), "lines")).distinct()
    per_doc = wanted.groupBy(*_DOC).agg(F.collect_list(F.struct("at", "lines")).alias("f"))
    # one plan at every size: the texts move once, to their few places
    body = docs.select(*_key(F.col("doc_id"), F.col("text")), _lines(F.col("text")).alias("l")).join(per_doc.hint("merge"), [*_DOC])
    cut = body.select(*_DOC, "l", F.explode("f").alias("f")).select(*_DOC, "f.*", F.array_join(F.slice("l", F.col("f.at") + 1, F.col("f.lines")), "\n").alias("bytes"))
    cut = stored(cut, "line-bytes").dropDuplicates([*_DOC, "at", "lines"])
    own = pieces.join(cut, [*_DOC, "at", "lines"])
    there = cut.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("at").alias("at_o"), "lines", F.col("bytes").alias("first"))
    return own.join(there, [*_FIRST, "lines"]).filter(F.col("bytes") == F.col("first")).select(*_DOC, "at", "lines", "words").distinct()


def dedup_lines(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``, and n_lines, n_removed, removed_words.

    Neighbouring repeated chunks form a span; spans below ``least_words`` words stay. A passage of at least five lines,
    or with a line of ``long_words`` words, is found wherever it stands; a shorter one unless repeated lines stand on both
    sides of it. NULL texts stay NULL with no lines removed; an empty table gives an empty result; rows equal in id
    and text count as one document and are cut alike. Columns of ``docs`` named like an added one are replaced.
    """
    added = ["n_lines", "n_removed", "removed_words"]
    keep = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*keep).alias("doc"), "doc_id", F.col(text).alias("text"))
    gone = repeats(rows.select("doc_id", "text"), least_words, long_words)
    spans = _with_spans(gone).groupBy(*_DOC, "_s").agg(F.min("at").alias("at"), F.sum("lines").cast("int").alias("lines"), F.sum("words").alias("words")).filter(F.col("words") >= least_words)
    cuts = spans.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("at", "lines"))).alias("cuts"), F.sum("lines").alias("n"), F.sum("words").alias("w"))
    cuts = stored(cuts, "line-cuts")
    rows = rows.select("doc", "text", *_key(F.col("doc_id"), F.col("text"))).join(cuts.hint("merge"), [*_DOC], "left")
    end = lambda c: c["at"] + c["lines"]
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("cuts")),
        lambda i: F.struct(F.coalesce(end(F.get("cuts", i - 1)), F.lit(0)).alias("a"), F.coalesce(F.get("cuts", i)["at"], F.size("l")).alias("b")),
    )
    left = F.flatten(F.transform(pieces, lambda p: F.slice(F.col("l"), p["a"] + 1, F.greatest(p["b"] - p["a"], F.lit(0)))))
    rows = rows.withColumn("l", _lines(F.col("text")))
    cleaned = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return rows.select(
        *[cleaned.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in keep], F.size("l").cast("bigint").alias("n_lines"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("w", F.lit(0)).cast("bigint").alias("removed_words"),
    )
