"""Token alignment against a plain walk over every text, and link counts against counting one by one."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from axonframe.llm import align

pytestmark = pytest.mark.skipif(not Path(align.FOLDER).exists(), reason="no vocabularies")


@pytest.fixture(scope="module")
def codec():
    return align.Codec()


def whole(codec, text):
    """Ids and byte intervals of a whole text under both libraries, without splitting it."""
    a = codec.first.encode(" " + text, add_special_tokens=False).ids
    b = codec.second.encode(text)
    out = []
    for side, ids in enumerate((a, b)):
        tokens = [codec.bytes[side][i] for i in ids]
        if b"".join(tokens) != (" " + text).encode():
            return None
        at = np.cumsum([0, *map(len, tokens)]).tolist()
        out.append([(i, s, e) for i, s, e in zip(ids, at, at[1:])])
    return out


def plain(codec, texts):
    docs, pairs = [], Counter()
    for t in texts:
        both = whole(codec, t) if t else None
        if both is None:
            docs.append((0, 0, [], []))
            continue
        a, b = both
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for c in cuts:
            groups.append(([i for i, s, e in a if low < e <= c], [i for i, s, e in b if low < e <= c]))
            low = c
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        pairs.update(links)
        docs.append((len(a), len(b), groups, links))
    top = {}
    for (_, y), n in pairs.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(pairs[p] == top[p[1]] for p in links)
        out.append((n_a, n_b, len(groups), len(links), best, sum(pairs[p] for p in links), text))
    return out


def texts(seed, n=120):
    rnd = random.Random(seed)
    bits = ["hello", " world", "don't", "  ", "\n", "\n\n ", "\t", "\r\n", "\r", " \r", "x;\r\n", "　", "\xa0", "é", "naïve", "日本語", "🙂", "▁", " ▁b", "<|endoftext|>", "</s>", "<s>", "<unk>", "<0x0A>", "1234567", "...", "\x00", "\x85", " ", "ǅ", "supercalifragilistic", "://", "a", "b", " "]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(n)]
    return [*out, "", None, " ", "   ", "\n", " \n ", "a ", "a\r", "word" * 300, "a b " * 400]


def test_words_give_the_tokens_of_whole_texts(codec):
    assert codec.split
    for t in texts(1, 1500):
        if not t:
            continue
        words = codec.pieces(" " + t)
        assert "".join(words) == " " + t
        numbers = codec.lookup(words)
        a, b = codec.tokens(numbers, 0)[0].tolist(), codec.tokens(numbers, 1)[0].tolist()
        assert a == codec.first.encode(" " + t, add_special_tokens=False).ids, ascii(t)
        # a text with the library's own mark for a blank is never given back
        assert align.MARK in t or b == codec.second.encode(t), ascii(t)
        assert bool(codec.sound[numbers].all()) == (whole(codec, t) is not None), ascii(t)


def test_coalesce_is_overlap():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        a = np.unique(np.append(rng.integers(1, n + 1, n // 2), n))
        b = np.unique(np.append(rng.integers(1, n + 1, n // 3), n))
        ga, gb, la, lb = align.coalesce(a, b)
        cuts = np.intersect1d(a, b)
        assert ga.tolist() == np.searchsorted(cuts, a).tolist() and gb.tolist() == np.searchsorted(cuts, b).tolist()
        sa, sb = np.append(0, a[:-1]), np.append(0, b[:-1])
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if sa[i] < b[j] and sb[j] < a[i]}
        assert len(la) == len(want) and set(zip(la.tolist(), lb.tolist())) == want


@pytest.mark.parametrize("frequent", [3, 1 << 17])
def test_alignments_and_counts(spark, codec, monkeypatch, frequent):
    rows = list(enumerate(texts(2)))
    rows += [(0, rows[0][1]), (None, "no id"), (None, "no id")]
    want = plain(codec, [t for _, t in rows])
    schema = "doc_id bigint, text string, row string, a string, groups string"
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], schema).repartition(4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in align.align(df, frequent=frequent).collect()), key=key)
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    got = sorted(((r.doc_id, r.groups) for r in align.align(df, digest=True).collect()), key=key)
    assert got == sorted(((i, hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "") for (i, _), w in zip(rows, want)), key=key)


def test_long_texts_are_cut_between_words(codec, monkeypatch):
    monkeypatch.setattr(align, "SLICE", 50)
    rnd = random.Random(4)
    docs = [" ".join(rnd.choice(["alpha", "beta\n", "gam ma", "x" * 70, "日本"]) for _ in range(60)) for _ in range(5)] + ["▁bad " + "word " * 40, "ok"]
    monkeypatch.setattr(align, "_codec", lambda files: codec)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(range(len(docs))), pa.array(docs)], ["row", "doc_id", "text"])
    assert max(len(list(codec.parts(" " + d))) for d in docs) > 3
    got = [r for out in align._align((), False)([batch]) for r in out.to_pylist()]
    for r, w in zip(got, plain(codec, docs)):
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) == (*w[:4], w[6])
        assert sum(r["m"]) == w[3] and len(set(zip(r["a"], r["b"]))) == len(r["a"])


def test_empty_table(spark):
    out = align.align(spark.createDataFrame([], "doc_id bigint, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
