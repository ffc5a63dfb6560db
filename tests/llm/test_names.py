"""Columns of a caller whose names the operators use themselves."""

import pytest

from axonframe.llm import lines, mixing, quality, shards, urls

NAMES = {
    "op1": ["rules", "_best", "page", "n", "node", "trust_", "o"],
    "op3": ["quota", "_h", "_first", "doc", "_shard", "_end", "_nb", "_s", "_i", "_tokens"],
    "op6": ["_w", "_l", "doc", "n", "rep"],
    "op7": ["n", "w", "cuts", "_l", "l", "k1", "k2", "doc", "at", "chunk"],
    "op10": ["item", "_key", "_id", "_big", "_chunk", "doc", "_n", "_at", "_start"],
}
RUN = {
    "op1": lambda df: urls.judge(df, urls.rule_table(df.sparkSession)),
    "op3": lambda df: mixing.materialise(mixing.mix(df)),
    "op6": quality.ledger,
    "op7": lines.dedup_lines,
    "op10": lambda df: shards.assign(df, 2),
}


@pytest.mark.parametrize("op", sorted(NAMES))
def test_names_come_through(spark, op):
    names = NAMES[op]
    rows = [(i, f"http://h{i}.org/a", "", "some words of a text " * 9, "s", *[f"{n}{i}" for n in names]) for i in range(4)]
    schema = "doc_id bigint, url string, html string, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame(rows, schema)
    out = RUN[op](df)
    assert set(df.columns) <= set(out.columns)
    got = out.select("doc_id", *[f"`{n}`" for n in names]).distinct().collect()
    assert {tuple(r) for r in got} <= {(r[0], *r[5:]) for r in rows} and got
    if op != "op3":
        assert len(got) == 4
