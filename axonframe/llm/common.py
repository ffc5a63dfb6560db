"""Helpers shared by the corpus operators: word patterns, scratch tables, let-bindings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.session import ensure_checkpoint_dir

# White space is space and the controls 09-0D; a word is a run of anything else.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
FOREST = 1 << 20  # nodes a task remembers while it thins out edges
BLANKS = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    The folder is ``spark.checkpoint.dir``; its files are scratch, as those of ``checkpoint()`` are.
    The table cuts the lineage, survives lost executors and gives the planner true sizes.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`stored` table that a loop has replaced."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (an expression used inside a lambda is
    otherwise evaluated for every element)."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """Words of a text; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def n_tasks(spark: SparkSession) -> int:
    """Partitions of a step that costs CPU, not bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): for nodes of ``edges`` (u, v), the smallest node that can be reached.

    Every partition first reduces its edges to a spanning forest with union-find, so that copies of a
    link and cycles inside a partition go before any shuffle. Then large-star and small-star rounds hang
    every node on the smallest one it knows, until all components are stars. Only aggregates and joins on
    the node are used; the hub of a large component has one row per member, which a skewed join splits.
    """
    forest = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).filter("u <> v").mapInPandas(_forest, "u bigint, v bigint")
    edges = stored(forest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        new = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(edges)
        edges = new
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(edges: DataFrame) -> bool:
    """Every node hangs on one smaller node, which itself hangs on none."""
    if not edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def _forest(batches):
    import pandas as pd

    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != x:
            parent[x], x = root, p
        return root

    for pdf in batches:
        u_out, v_out = [], []
        if len(parent) > FOREST:
            parent.clear()  # later edges start a new forest: more of them stay, none is lost
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
                u_out.append(u)
                v_out.append(v)
        yield pd.DataFrame({"u": u_out, "v": v_out}, dtype="int64")
