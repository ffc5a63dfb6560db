"""Near-duplicate groups against all pairs, signatures against the plain algorithm."""

import random

import numpy as np
import pytest

from axonframe.llm import near
from axonframe.llm.common import components

MASK = 0xFFFFFFFF


def plain_signature(elements, slots):
    best = [2**64 - 1] * slots
    for e in elements:
        p = list(range(slots))
        for j in range(slots):
            bits = int(near._mix(np.array([(int(e) + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            k = j + ((bits & MASK) * (slots - j) >> 32)
            p[j], p[k] = p[k], p[j]
            best[p[j]] = min(best[p[j]], (j << 32) | (bits >> 32))
    return best


@pytest.mark.parametrize("size", [1, 2, 3, 9, 40, 300])
def test_signature_is_superminhash(size):
    rng = np.random.default_rng(size)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (size, 5, 700)]
    got = near.signatures(sets, 16)
    assert [g.tolist() for g in got] == [plain_signature(s, 16) for s in sets]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    shared, errors = rng.integers(0, 2**63, 900).astype(np.uint64), []
    for _ in range(60):
        a = np.unique(np.concatenate([shared, rng.integers(0, 2**63, 100).astype(np.uint64)]))
        b = np.unique(np.concatenate([shared, rng.integers(0, 2**63, 100).astype(np.uint64)]))
        x, y = near.signatures([a, b], 140)
        errors.append((x == y).mean() - 900 / 1100)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def all_pairs(rows, percent):
    s = sets_of(rows)
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s[i]), find(i)) for i in ids}


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    rows = []
    for _ in range(30):
        rows.append(" ".join(text(rnd.randint(1, 90))))
    for base in (text(60), text(150), text(400)):
        for _ in range(40):  # a family: some links are only to the middle, some only to a neighbour
            copy = list(base)
            for _ in range(rnd.randint(0, 7)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(" ".join(copy[: len(copy) - rnd.choice([0, 0, 0, 5, 20])]))
    rows += [rows[0]] * 4 + ["", None, "  \t\n", "One two", "one TWO", "É é a b c d", "é é a b c d"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_are_those_of_all_pairs(spark, percent):
    rows = corpus(percent)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_groups(df, percent=percent).collect()}
    assert got == all_pairs(rows, percent)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None), (9, None)]
    out = near.near_groups(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, component_id string, kept int")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles, r.kept) for r in out) == [(0, 0, 0, True), (0, 0, 2, True), (5, 5, 2, True), (5, 5, 2, True), (7, 5, 2, False), (9, 9, 0, True)]
    empty = near.near_groups(spark.createDataFrame([], "doc_id bigint, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept", "text_md5"]


def test_an_id_that_repeats_with_another_text(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(0)), (5, text(0)), (5, text(1)), (7, text(2)), (8, text(1) + " more")]
    out = near.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 7, True), (8, 5, False)]


def test_a_pivot_with_many_partners(spark, monkeypatch):
    monkeypatch.setattr(near, "PARTNERS", 7)
    rows = corpus(17)
    got = {r.doc_id: r.component_id for r in near.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: c for i, (_, c) in all_pairs(rows, 85).items()}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(7)).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
