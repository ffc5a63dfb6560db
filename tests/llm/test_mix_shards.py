"""Apportionment, mixing and differencing against plain versions."""

import random
import zlib
from itertools import product

from pyspark.sql import functions as F

from axonframe.llm import mixing, shards


def highest_quotients(votes, seats, caps):
    seats_of = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if seats_of[i] < caps[i]]
        if not open_:
            break
        best = max(open_, key=lambda i: (votes[i] / (2 * seats_of[i] + 1), -i))
        seats_of[best] += 1
    return seats_of


def test_sainte_lague_is_the_quotient_rule(spark):
    rnd = random.Random(4)
    for trial in range(4):
        votes = [rnd.choice([0, 1, 7, 50, 333, 9000]) * rnd.randint(1, 9) for _ in range(rnd.randint(1, 25))]
        seats = rnd.choice([0, 1, 13, 240])
        caps = [10**9] * len(votes) if trial % 2 else [rnd.choice([0, 2, 400]) for _ in votes]
        df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip(votes, caps))], "id int, votes bigint, cap bigint")
        out = mixing.sainte_lague(df, [], F.least(F.lit(seats), F.lit(sum(caps))), "votes", "cap", [F.col("id")]).collect()
        got = [r.quota for r in sorted(out, key=lambda r: r.id)]
        if trial % 2 and any(votes):
            assert got == highest_quotients(votes, seats, caps)
        assert all(g <= c for g, c in zip(got, caps)) and (trial % 2 == 0 or sum(got) == seats)


def filled(sizes, weights, most=2):
    """Targets by repeated resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def test_mix(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["b", "b", "b", "a", "ç", "z", None]), " ".join(["w"] * rnd.randint(0, 300)), 1) for i in range(900)]
    rows += [(5000, "big", "w " * 40_000, 1), (None, "a", "one two", 1), (None, "a", "one two", 1), (5001, None, None, 1), (5002, "void", "", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, taken int")
    out = mixing.mix(df, rows_per_shard=64).collect()
    again = mixing.mix(df.repartition(5), rows_per_shard=64).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    sizes, taken = {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = filled(sizes, mixing.WEIGHTS)
    n_shards = -(-len(rows) // 64)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= mixing.BLOCK_WORDS * (n_shards + 1)
    copies = mixing.materialise(mixing.mix(df)).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in copies if r.doc_id is not None) <= 2
    assert mixing.mix(df.limit(0)).count() == 0


def test_differencing_is_tight_and_exact_on_small_cases():
    a = shards.differencing([8, 7, 6, 5, 4], 2)  # the textbook case: differencing leaves 14 and 16
    assert sorted(sum(s for s, x in zip([8, 7, 6, 5, 4], a) if x == k) for k in range(2)) == [14, 16]
    rnd = random.Random(6)
    for _ in range(20):
        sizes = [rnd.randint(1, 40) for _ in range(7)]
        at = shards.differencing(sizes, 3)
        load = [sum(s for s, a in zip(sizes, at) if a == k) for k in range(3)]
        best = min(max(sum(s for s, a in zip(sizes, p) if a == k) for k in range(3)) for p in product(range(3), repeat=7))
        assert max(load) <= best * 4 / 3
    big = [rnd.randint(1, 10**6) for _ in range(4000)]
    load = [0] * 8
    for s, a in zip(big, shards.differencing(big, 8)):
        load[a] += s
    assert max(load) - min(load) < 1000
    assert shards.differencing([], 4) == []


def test_assign(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice("abcdé") * rnd.randint(0, 2000), 1) for i in range(1500)] + [(None, None, 1), (7, None, 1), (7, None, 1), (9, "", 1)]
    rows += [(2000 + i, "the same text", 1) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    out = shards.assign(df, 8, bins=64).collect()
    assert len(out) == len(rows)
    where, load = {}, [0] * 8
    for r in out:
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert where.setdefault(r.text or "", r.shard) == r.shard
        load[r.shard] += r.size
    for k in range(8):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    assert max(load) - min(load) <= 2000
    key = lambda r: (str(r.doc_id), r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, shards.assign(df.repartition(3), 8, bins=64).collect())) == sorted(map(key, out))
    assert shards.assign(df.limit(0), 8).count() == 0
