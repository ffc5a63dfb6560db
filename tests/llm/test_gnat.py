"""Hard negatives against all pairs; the tree's ranges and its choice of leaves against plain distances."""

import math
import random

import numpy as np
import pytest

from axonframe.llm import gnat


def plain(rows, every=100):
    ok = {}
    for i, label, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None), key=lambda r: r[:2]):
        if all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(np.float32(x))) for x in v]
            ok[i] = min(ok.get(i, (label, q)), (label, q))
    dims = max((len(q) for _, q in ok.values()), default=0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in ok.items():
        if a % every:
            continue
        scores = {i: dot(q, v) for i, (_, v) in ok.items() if i != a}
        by = lambda i: (-scores[i], i)  # noqa: B023, E731
        for p in sorted((i for i in scores if ok[i][0] == label), key=by)[:5]:
            fit = sorted((i for i in scores if ok[i][0] != label and 30 * scores[p] <= 100 * scores[i] <= 90 * scores[p]), key=by)[:10]
            out += [(a, p, n + 1, i, scores[p], scores[i]) for n, i in enumerate(fit)]
    assert dims or not out
    return sorted(out)


def clustered(n, dims, seed, labels=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (labels, dims))
    rows = []
    for i in range(n):
        k = int(rng.integers(labels))
        v = centers[k] * 0.4 + rng.normal(0, 0.15, dims)
        rows.append((i, k if rng.random() < 0.8 else int(rng.integers(labels)), [float(x) for x in v.astype(np.float32)]))
    return rows


def run(spark, rows, every=100, **index):
    df = gnat.prepared(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(5))
    ready = gnat.named_once(df)
    out = gnat.hard_negatives(ready, anchor_every=every, index=gnat.Index(ready, **index))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("dims,index", [(3, {"sample": 60, "leaf_rows": 10, "fanout": 3}), (16, {"sample": 40, "leaf_rows": 30}), (8, {})])
def test_negatives_are_those_of_all_pairs(spark, dims, index):
    rows = clustered(700, dims, dims)
    assert run(spark, rows, 20, **index) == plain(rows, 20)


def test_odd_rows(spark):
    rnd = random.Random(3)
    v = lambda n=6: [rnd.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(n)]
    rows = [(i, rnd.randint(0, 2), v(rnd.choice([6, 6, 4]))) for i in range(150)]
    rows += [(200 + i, 1, [0.5] * 6) for i in range(60)] + [(300 + i, 2, [0.5] * 6) for i in range(40)]  # copies
    rows += [(400, None, v()), (410, 1, None), (420, 1, [0.1, None]), (430, 1, [float("nan")] * 6), (440, 1, [float("inf")] * 6), (None, 1, v()), (450, 0, []), (460, 2, [0.0] * 6)]
    rows += [rows[10], (30, 2, v()), (30, 0, v()), (470, 1, [-0.5] * 6)]
    assert run(spark, rows, 10, sample=20, leaf_rows=16, fanout=3) == plain(rows, 10)
    assert run(spark, rows, 10) == plain(rows, 10)


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [float(np.float32(x)) for x in np.random.default_rng(i).normal(0, 1e5, 5)]) for i in range(60)]
    assert run(spark, rows, 10, leaf_rows=20, fanout=2) == plain(rows, 10)
    rows = [(i, i % 2, [float(np.float32(2.0 ** (i % 40 + 80))), 1.0]) for i in range(60)]
    assert all(abs(r[4]) == 2**63 - 1 for r in run(spark, rows, 10) if r[0] > 20)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0])]) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 0, [0.5])]) == plain([(0, 1, [1.0]), (1, 1, [1.0]), (2, 0, [0.5])])


def test_leaves_that_hold_the_annulus_are_kept(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (3000, 4))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    tree = gnat.fit(x[:300], float((x * x).sum(axis=1).max()) + 1, 3, 4)
    leaf, ranges = tree.route(x)
    for s in tree.split:
        tree.low.append(np.full((len(s), len(s)), np.inf))
        tree.high.append(np.full((len(s), len(s)), -np.inf))
    for (node, j), (low, high) in ranges.items():
        tree.low[node][:, j], tree.high[node][:, j] = low, high
    q = x[:200]
    score = q @ x.T
    high = np.sort(score, axis=1)[:, -40]
    low = np.sort(score, axis=1)[:, -60]
    d = lambda s: np.sqrt(np.maximum((q * q).sum(axis=1) + tree.top - 2 * s, 0))[:, None]
    alive = tree.alive(q, d(high), d(low))
    for i in range(len(q)):
        need = set(leaf[(score[i] >= low[i]) & (score[i] <= high[i])].tolist())
        assert need <= set(alive[i])
    assert np.mean([len(a) for a in alive]) < 0.7 * tree.leaves  # ranges leave some out
