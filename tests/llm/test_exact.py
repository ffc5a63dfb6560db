"""Exact duplicates against plain grouping, colliding digests and rows that repeat."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from axonframe.llm import exact

BLANKS = str.maketrans("", "", " \t\n\x0b\x0c\r")


def plain(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault((t or "").translate(BLANKS), []).append((-len(t or ""), i is None, i or 0, n))
    out = []
    for n, (i, t) in enumerate(rows):
        norm = (t or "").translate(BLANKS)
        best = min(groups[norm])
        out.append((i, None if best[1] else best[2], len(groups[norm]), best[3] == n, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def got(df):
    return [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in df.collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def corpus(seed):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))) for _ in range(60)] + ["", None, " \t\n", " ", "É", "é"]
    rows = [(i, rnd.choice(texts)) for i in range(300)]
    rows += [(1000 + i, rnd.choice([" same text ", "same\ntext", "sametext"])) for i in range(500)]
    rows += [(None, "sametext"), (None, "only here"), (-5, "same text   x"), (2**63 - 2, "samet extx"), (7000, "long " * 20_000), (7001, "long" * 20_000)]
    rnd.shuffle(rows)
    return rows


def test_groups_are_those_of_plain_grouping(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    assert order(got(exact.exact_groups(df))) == order(plain(rows))
    assert order(got(exact.exact_groups(df, hot=3, salts=2))) == order(plain(rows))


@pytest.mark.parametrize("hot", [2, 4096])
def test_colliding_digests_are_told_apart_by_content(spark, hot):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    weak = exact.exact_groups(df, digest=lambda norm: F.unhex(F.hex(F.pmod(F.crc32(norm.cast("binary")), F.lit(3)))), hot=hot)
    assert order([r[:4] for r in got(weak)]) == order([r[:4] for r in plain(rows)])


def test_rows_that_repeat(spark):
    rows = [(4, "a b"), (4, "a b"), (4, "a  b"), (None, "x"), (None, "x"), (9, "ab")]
    out = sorted((r.doc_id or 0, r.keep_id or 0, r.n_chars, r.kept) for r in exact.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert out == [(0, 0, 1, False), (0, 0, 1, True), (4, 4, 3, False), (4, 4, 3, False), (4, 4, 4, True), (9, 4, 2, False)]


def test_empty_table_and_clashing_names(spark):
    assert exact.exact_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    names = ["norm", "digest", "chars", "row", "score", "n", "salt", "hot", "kept", "k_digest", "k_id", "whole"]
    schema = "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names)
    rows = [(1, "a b", *names), (2, "ab", *names), (2, "ab", *names), (3, None, *names), (None, " ", *names)]
    df = spark.createDataFrame(rows, schema)
    kept = exact.dedup(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect() if r.doc_id) == [rows[0]]
    assert kept.count() == 2  # one text of blanks stays
    assert sum(r.kept for r in exact.exact_groups(df).collect()) == 2
