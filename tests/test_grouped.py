"""A user's function per group, fed batch by batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators.grouped import grouped_apply


@pytest.mark.parametrize("merge", [None, lambda a, b: a + b])
def test_groups_of_any_size(spark, merge):
    def total(state, batch):
        return state + np.array([batch.num_rows, batch.column("v").to_numpy().sum()])

    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 1000 != 1, (F.col("id") % 50).cast("string")).alias("g"), F.col("id").cast("double").alias("v"))
    out = grouped_apply(df, ["g"], lambda: np.zeros(2), total, lambda s: {"n": int(s[0]), "total": float(s[1])}, "n bigint, total double", merge)
    got = {r.g: (r.n, r.total) for r in out.collect()}
    want = {r.g: (r.n, r.t) for r in df.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("t")).collect()}
    assert got == want and None in got


def test_a_state_beyond_its_size_is_an_error(spark):
    df = spark.range(10).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    with pytest.raises(Exception, match="more than 100"):
        grouped_apply(df, ["g"], list, lambda s, b: s + b.column("v").to_pylist() * 100, lambda s: {"n": len(s)}, "n bigint", state_bytes=100).collect()
    assert grouped_apply(df.limit(0), ["g"], list, lambda s, b: s, lambda s: {"n": 0}, "n bigint").count() == 0
