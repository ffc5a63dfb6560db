"""Archives that are damaged, and pages of many layouts."""

import gzip
import hashlib
import random

import pytest

from axonframe.llm import blocks, warc


def archive(n, compress):
    recs = [warc.record_bytes(i, f"http://h/{i}", (f"payload {i} " * 50).encode()) for i in range(n)]
    return [warc._member(r) if compress else r for r in recs]


def read(data):
    got, gaps = [], []
    for kind, x in warc.salvage(data):
        (got if kind == "record" else gaps).append(x)
    return [int(f[b"warc-record-id"][10:-1]) for _, f, _ in got], gaps


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_finds_every_whole_record(compress):
    parts = archive(12, compress)
    assert read(b"".join(parts)) == (list(range(12)), [])
    rnd = random.Random(5)
    for _ in range(60):
        data, hurt = bytearray(b"".join(parts)), rnd.randrange(12)
        start = sum(map(len, parts[:hurt]))
        kind = rnd.choice(["flip", "cut", "noise", "tail"])
        if kind == "flip":
            at = start + len(parts[hurt]) - 9 - rnd.randrange(200)  # in the block: header lines have no digest
            data[at] ^= 0x55
            ids, gaps = read(bytes(data))
            assert set(range(12)) - {hurt} <= set(ids)
        elif kind == "cut":
            k = rnd.randrange(1, len(parts[hurt]))
            del data[start : start + k]
            ids, gaps = read(bytes(data))
            assert set(range(12)) - {hurt} <= set(ids)
        elif kind == "noise":
            data[start:start] = bytes(rnd.randrange(256) for _ in range(200))
            ids, gaps = read(bytes(data))
            assert ids == list(range(12)) and gaps[0][0] == start and gaps[-1][1] == start + 200
        else:
            end = len(data) - rnd.randrange(1, len(parts[-1]))
            ids, gaps = read(bytes(data[:end]))
            assert ids == list(range(11)) and gaps[-1][1] == end
        for a, b, reason in gaps:
            assert a < b and reason


def test_odd_archives():
    assert read(b"") == ([], []) and read(b"no archive at all")[1] == [(0, 17, "no gzip member")]
    assert read(gzip.compress(b"not a record"))[0] == []
    lone = warc.record_bytes(None, None, b"")
    assert list(warc.salvage(lone))[0][0] == "record"


def test_gzip_bodies_and_members_of_many_records():
    rnd = random.Random(9)
    recs = [warc.record_bytes(i, f"http://h/{i}", gzip.compress(rnd.randbytes(3000)) if i % 3 else rnd.randbytes(900)) for i in range(60)]
    plain = b"".join(recs)
    assert read(plain) == (list(range(60)), [])
    hurt = bytearray(plain)
    at = sum(map(len, recs[:7])) + len(recs[7]) - 99
    hurt[at] ^= 0x55
    ids, gaps = read(bytes(hurt))
    assert ids == [i for i in range(60) if i != 7] and gaps[0][0] == sum(map(len, recs[:7])) and gaps[-1][1] == sum(map(len, recs[:8]))
    one = gzip.compress(plain)
    assert read(one)[0] == list(range(60)) and read(recs[0] + warc._member(recs[1]) + recs[2]) == ([0, 1, 2], [])
    cut = one[: len(one) // 2]
    ids, gaps = read(cut)
    assert len(ids) > 20 and ids == list(range(len(ids))) and gaps == [(0, len(cut), "gzip member is cut off")]
    ids, gaps = read(cut + b"\xff" * 50 + warc._member(recs[59]))
    assert len(ids) > 20 and ids[-1] == 59 and ids[:-1] == list(range(len(ids) - 1)) and gaps[0][0] == 0


@pytest.mark.parametrize("compress", [True, False])
def test_urls_of_any_length(compress):
    urls = ["http://h/" + " " * 30_000, "http://h/" + "x" * 200_000, "http://h/WARC/1.1", None]
    recs = [warc.record_bytes(i, u, b"payload") for i, u in enumerate(urls)]
    data = b"".join(warc._member(r) if compress else r for r in recs)
    assert read(data) == (list(range(4)), [])
    inner = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Date: x\r\nContent-Length: 10\r\n\r\nWARC/1.1\r\n\r\n\r\n"
    assert read(inner) == ([7], [])
    assert [len(f[b"warc-target-uri"]) for _, (_, f, _) in warc.salvage(data)] == [90_009, 200_009, 17, 0]


def test_round_trip(spark):
    big = "<p>same</p>" * 200
    rows = [(1, "http://a", big, 1), (5, "http://b", big, 1), (5, "http://b", big, 1), (3, None, big, 1), (None, "http://n", big, 1), (7, "http://s", "tiny", 1), (8, "http://s", "tiny", 1), (9, "x y\r\nz", None, 1), (2**60 + 1, "u", "é" * 9000, 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int")
    out = warc.read_archives(warc.write_archives(warc.plan_records(df.repartition(3)), limit=3000)).collect()
    assert len(out) == len(rows) and all(r.reason is None for r in out)
    for r in out:
        raw = next((h or "").encode() for i, _, h, _ in rows if i == r.page_id)
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha1(raw).hexdigest()
        revisit = r.page_id in (1, 3, None)
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == raw
    assert warc.read_archives(warc.write_archives(warc.plan_records(df.limit(0)))).count() == 0


def test_gaps_are_logged(spark):
    parts = archive(5, True)
    data = parts[0] + b"\x1f\x8b\x08garbage" + parts[1] + parts[2][:-9] + parts[3]
    out = warc.read_archives(spark.createDataFrame([("a.warc.gz", bytearray(data)), ("none", None)], "path string, content binary"))
    assert sorted(r.page_id for r in warc.records(out).collect()) == [0, 1, 3]
    gaps = sorted((r["at"], r.until) for r in warc.gaps(out).collect())
    assert gaps[0] == (len(parts[0]), len(parts[0]) + 10) and len(gaps) == 2


def test_labeller_on_layouts_it_has_not_seen():
    pages = blocks.generated_pages(200, seed=77)
    marks = blocks.label(blocks.trained(), [blocks.leaf_blocks(h) for h, _ in pages])
    right = sum(int((a == b).sum()) for a, (_, b) in zip(marks, pages))
    assert right / sum(len(y) for _, y in pages) > 0.97


def test_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    p = blocks._new_weights(1)
    x, mask = rng.normal(0, 1, (4, 2, p["wf"].shape[0])).astype(np.float32), np.ones((4, 2), np.float32)
    mask[3, 1] = 0
    hs, saved = blocks._lstm(x, p["wf"], p["uf"], p["bf"], mask, keep=True)
    d = rng.normal(0, 1, hs.shape).astype(np.float32)
    _, du, db = blocks._lstm_back(d, x, p["wf"], p["uf"], saved)
    for name, grad, at in (("uf", du, (3, 9)), ("bf", db, (5,)), ("bf", db, (40,))):
        q = {k: v.astype(np.float64) for k, v in p.items()}
        loss = []
        for e in (1e-3, -1e-3):
            w = {k: v.copy() for k, v in q.items()}
            w[name][at] += e
            loss.append((blocks._lstm(x.astype(np.float64), w["wf"], w["uf"], w["bf"], mask)[0] * d).sum())
        assert abs((loss[0] - loss[1]) / 2e-3 - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_leaf_blocks():
    texts = lambda h: [t for _, t, _ in blocks.leaf_blocks(h)]
    assert texts(None) == [] and texts("") == [] and texts("plain") == ["plain"]
    assert texts("<p><b>A &amp;&lt;b&gt;<br><p>B\n\n C</p>tail") == ["A &<b>", "B C", "tail"]
    assert texts("<script>var t='</p>';</script><style>p{}</style><!-- <p>x</p> --><p>y") == ["y"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("a < b and <p>c</p") == ["a < b and", "c"] and texts("<p>cut <a href='x") == ["cut"] and texts("<p>cut<!-- never") == ["cut"]
    assert texts("<div><noscript>no</noscript><select><option>o</select>yes</div>") == ["yes"]
    assert texts("<a " * 20_000) == []


def test_extract(spark):
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Head</h1><p>One &amp; two.</p><p>Three.</p></article><footer>&copy; me</footer></body></html>'
    rows = [(1, "u", page, 0), (1, "u", page, 0), (None, None, page, 0), (2, "v", None, 0), (3, "w", "", 0)]
    out = blocks.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in out)
    assert got == [(0, "Head\nOne & two.\nThree.", 22), (1, "Head\nOne & two.\nThree.", 22), (1, "Head\nOne & two.\nThree.", 22), (2, "", 0), (3, "", 0)]
    assert blocks.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("digest", ["sha1:{hex}", "SHA1:{HEX}", "sha1:{b32}", "sha1:{b64}", "sha-256:{s256}", "blake9:abc", None])
def test_foreign_digests_and_headers(digest, zipped):
    import base64

    def record(i, eol):
        block = b"HTTP/1.1 200 OK" + eol + eol + b"payload %d" % i
        sha = hashlib.sha1(block).digest()
        head = [b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID: <urn:page:%d>" % i, b"WARC-Date: 2020-01-01T00:00:00Z", b"WARC-Target-URI: http://a/" + eol + b"   folded", b"Content-Length: %d" % len(block)]
        if digest:
            value = digest.format(hex=sha.hex(), HEX=sha.hex().upper(), b32=base64.b32encode(sha).decode(), b64=base64.b64encode(sha).decode(), s256=hashlib.sha256(block).hexdigest())
            head.append(b"WARC-Block-Digest: " + value.encode())
        return eol.join(head) + eol + eol + block + eol + eol

    raw = [record(i, eol) for i, eol in enumerate((b"\r\n", b"\n", b"\r\n"))]
    data = b"".join(gzip.compress(r) if zipped else r for r in raw)
    got = list(warc.salvage(data))
    assert [k for k, _ in got] == ["record"] * 3
    rows = [warc._row("p", *x) for _, x in got]
    assert [r[4] for r in rows] == [0, 1, 2] and rows[1][5] == "http://a/ folded"
    assert all(r[-1] == (digest is not None and "blake9" not in digest) for r in rows)
    if digest and "blake9" not in digest:
        wrong = b"".join(raw).replace(b"payload 1", b"payload 7")
        kinds = [k for k, _ in warc.salvage(wrong)]
        assert kinds == ["record", "gap", "record"]


def test_declared_payload_digest_of_a_revisit_is_hex():
    import base64

    sha = hashlib.sha1(b"x").digest()
    fields = {b"warc-type": b"revisit", b"warc-payload-digest": b"sha1:" + base64.b32encode(sha)}
    assert warc._row("p", 0, fields, b"HTTP/1.1 200 OK\r\n\r\n")[10] == sha.hex()


def test_deep_nesting_takes_time_in_proportion():
    import time

    t0 = time.time()
    found = blocks.leaf_blocks("<div class='a b'>x" * 60_000)
    assert len(found) == 60_000 and found[-1][0].depth == 180_000 and time.time() - t0 < 20
    assert found[5][0].slots == found[-1][0].slots  # the same names on the path


def test_long_pages_are_read_in_parts(monkeypatch):
    p = blocks._new_weights(3)
    page = blocks.leaf_blocks("".join(f"<div class=c{i % 7}><p>word{i} and more words</p></div>" for i in range(90)))
    whole = blocks.label(p, [page])[0]
    monkeypatch.setattr(blocks, "LONG_PAGE", 16)
    assert (blocks.label(p, [page, page[:10]])[0] == whole).all()
