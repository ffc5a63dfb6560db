"""The pipeline against a plain version of each stage, on one small corpus."""

import hashlib
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as pipeline
from axonframe.llm import mixing
from test_lines_templates import plain_leaks
from test_mix_shards import filled, highest_quotients
from test_near import all_pairs
from test_quality_chat_urls import repeat_words

ITEMS = [(i, " ".join(f"item{i}word{j}" for j in range(25))) for i in range(4)] + [(9, "A bus with 40 seats and 40 belts drives from Rome to Bonn. How many seats does Rome see at noon?")]


def corpus():
    rnd = random.Random(31)
    vocabulary = [f"term{i}" for i in range(600)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    rows = []
    for i in range(260):
        t = text(rnd.randint(30, 260))
        if i % 7 == 0 and rows:
            words = rnd.choice(rows)[1].split()
            words[rnd.randrange(len(words))] = "edit"
            t = " ".join(words)
        elif i % 11 == 0:
            t += " " + ITEMS[i % 4][1] + " " + text(20)
        elif i % 13 == 0:
            t += ". A bus with 90 seats and 90 belts drives from Pisa to Bonn. How many seats does Pisa see at noon? " + text(9)
        elif i % 17 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif i % 19 == 0:
            t = "again and again " * 60
        rows.append((i, t, rnd.choice(["de", "en", None]), rnd.choice(["a", "a", "a", "b", "c", None]), len(t), i % 3))
    rows += [(1000, None, None, None, None, 0), (1001, "", "en", "a", 0, 0), (1002, text(20_000), "en", "b", 1, 0)]
    rows += [rows[1], rows[1], (None, text(80), "en", "a", 1, 0), (None, "too short", "en", "a", 1, 0), (None, text(60) + " " + ITEMS[2][1], "en", "a", 1, 0)]
    return rows


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int"


def plain_quality(rows):
    out = []
    for r in rows:
        t = r[1] or ""
        words, lines = t.split(), [x for x in t.split("\n") if x.split()]
        n, chars = len(words), sum(map(len, words))
        upper, lower = sum(c.isupper() for c in t), sum(c.islower() for c in t)
        bad = n < 50 or 100 * repeat_words(words) > 50 * n or 10 * sum(c in "#*$%&|<>" for c in t) > n or 2 * (len(lines) - len(set(lines))) > len(lines)
        if not (bad or chars < 2 * n or chars > 15 * n or 2 * upper > upper + lower):
            out.append(r)
    return out


def plain_dedup(rows):
    groups = all_pairs([r[:2] for r in rows if r[0] is not None], pipeline.PERCENT)
    out, seen = [], set()
    for r in rows:
        if r[0] is None or groups[r[0]][1] == r[0] and r[0] not in seen:
            out.append(r)
            seen.add(r[0])
    return out


def plain_mix(rows):
    """Every word of the mix one by one: targets, quotas by repeated highest quotients, runs of blocks."""
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    tag = lambda i: "7" if i is None else f"7|{i}"
    k, b = max(1, -(-len(rows) // mixing.ROWS_PER_SHARD)), mixing.BLOCK_WORDS
    parts = {}
    for r in rows:
        parts.setdefault((r[3], number(tag(r[0])) % k), []).append(r)
    size = {p: sum(len((r[1] or "").split()) for r in rs) for p, rs in parts.items()}
    sources = sorted({p[0] for p in parts}, key=lambda s: (s is None, s or ""))
    per = {s: sum(v for p, v in size.items() if p[0] == s) for s in sources}
    target, blocks = filled(per, mixing.WEIGHTS), {p: -(-v // b) for p, v in size.items()}
    caps = {s: 2 * sum(v for p, v in blocks.items() if p[0] == s) for s in sources}
    seats = min((6 * sum(per.values()) + 2 * b) // (4 * b), sum(caps.values()))
    quota = dict(zip(sources, highest_quotients([target[s] for s in sources], seats, [caps[s] for s in sources])))
    out = []
    for s in sources:
        mine = sorted(p for p in parts if p[0] == s)
        want = caps[s] if target[s] >= 2 * per[s] else quota[s]
        for p, q in zip(mine, highest_quotients([size[p] for p in mine], want, [2 * blocks[p] for p in mine])):
            n = max(blocks[p], 1)
            first, extra = number(f"7|{p[1]}" + ("" if s is None else f"|{s}")) % n, q % n
            chosen = {(first + i) % n for i in range(extra)}
            at = 0
            for r in sorted(parts[p], key=lambda r: (hashlib.md5(tag(r[0]).encode()).hexdigest(), r[0] is not None, r[0] or 0, len((r[1] or "").split()))):
                w = len((r[1] or "").split())
                taken = q // n * w + sum(i // b in chosen for i in range(at, at + w))
                out += [r] * int(taken / max(w, 1) + 0.5)
                at += w
    return out


def count(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("shard_rows", [mixing.ROWS_PER_SHARD, 25])
def test_every_stage_and_the_whole(spark, tmp_path, monkeypatch, shard_rows):
    monkeypatch.setattr(mixing, "ROWS_PER_SHARD", shard_rows)
    monkeypatch.setattr(mixing.mix, "__defaults__", tuple(shard_rows if d == 2048 else d for d in mixing.mix.__defaults__))
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def leaks(rows):
        found = {i: plain_leaks([(0, r[1])], ITEMS)[0] for i, r in enumerate(rows)}
        return [r for i, r in enumerate(rows) if not found[i]]

    state, df = rows, docs
    for (name, stage), plain in zip(pipeline.STAGES[:-1], (plain_quality, plain_dedup, leaks, plain_mix)):
        df, before = stage(spark, df, str(tmp_path)), len(state)
        state = plain(state)
        got = df.collect()
        assert df.columns == docs.columns and count(got) == count(state), name
        assert len(state) != before, name
        df = spark.createDataFrame(got, COLUMNS)
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert count(r[:5] for r in whole) == count(r[:5] for r in state)
    shards_of = {}
    for r in whole:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert shards_of.setdefault(r.text, r.shard) == r.shard
    for k in range(pipeline.SHARDS):
        slots = sorted(r.slot for r in whole if r.shard == k)
        assert slots == list(range(len(slots)))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([], COLUMNS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, df, str(tmp_path)).count() == 0


def test_different_texts_of_one_id_stay(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1), "x", "s", 1, 1), (1, text(2), "x", "s", 1, 1), (1, text(1), "x", "s", 1, 1), (2, text(3), "x", "s", 1, 1)]
    out = pipeline.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, text(1)), (1, text(2)), (2, text(3))]
    rows = [(1, text(1), "x", "s", 1, 1), (5, text(1), "x", "s", 1, 1), (5, text(2), "x", "s", 1, 1), (7, text(3), "x", "s", 1, 1)]
    out = pipeline.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, text(1)), (5, text(2)), (7, text(3))]
