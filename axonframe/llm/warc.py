"""WARC archives: writer with revisit records, and a reader that salvages damaged archives.

Archives are byte streams of bounded size, kept as rows (path, content), which is also what
``spark.read.format("binaryFile")`` gives for archives that lie about as files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1\r\n"
LEAST_REVISIT = 1000  # payloads below this many bytes are stored every time
ARCHIVE_BYTES = 4 << 20  # an archive is closed once it holds so many bytes
GZIP = b"\x1f\x8b\x08"
_PIECE = 1 << 14  # bytes of a member that are inflated at once
_NEEDED = {b"warc-type", b"warc-record-id", b"warc-date", b"content-length"}
_SIZES = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64}  # digest bytes by algorithm
_DATE = b"2024-01-01T00:00:00Z"  # fixed, so that reruns write the same bytes


def plan_records(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to, record_type): which rows are stored and which revisit another.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes the row with the largest ``page_id`` is the
    response (all rows that repeat that id are); the others refer to it. Rows with a NULL id revisit
    like others; if no row of a payload has an id, all are responses.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("_d"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    # a row per payload that repeats; the join sends no page twice, and a hot payload is a skewed join
    last = pages.select(F.col("page_id").cast("bigint").alias("page_id"), payload.alias("payload")).filter(large)
    last = last.groupBy(F.unhex(F.sha1("payload")).alias("_d")).agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    joined = rows.join(last, "_d", "left")
    revisit = F.coalesce(large & F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last")), F.lit(False))
    return joined.select(
        "page_id", "url", "payload", F.when(revisit, F.col("_last")).alias("refers_to"), F.when(revisit, "revisit").otherwise("response").alias("record_type")
    )


def _urn(page) -> bytes:
    return b"<urn:page:%s>" % (b"none" if page is None else str(page).encode())


def record_bytes(page, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    digest = hashlib.sha1(payload).hexdigest().encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode())
    head = [
        b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"), b"WARC-Record-ID: " + _urn(page), b"WARC-Date: " + _DATE,
        b"WARC-Target-URI: " + uri, b"WARC-Payload-Digest: sha1:" + digest, b"WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode(),
        b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block),
    ]
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + _urn(refers_to), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return VERSION + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _write(compress: bool, limit: int):
    def run(batches):
        import os
        import uuid

        from pyspark import TaskContext

        ctx = TaskContext.get()
        stem = f"part-{ctx.partitionId():05d}" if ctx else f"part-{os.getpid()}-{uuid.uuid4().hex[:8]}"
        number, parts, size = 0, [], 0
        suffix = ".warc.gz" if compress else ".warc"
        for pdf in batches:
            for page, url, payload, ref in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"]):
                data = record_bytes(page, url, bytes(payload), ref)
                parts.append(_member(data) if compress else data)
                size += len(parts[-1])
                if size >= limit:
                    yield pd.DataFrame({"path": [f"{stem}-{number:05d}{suffix}"], "content": [b"".join(parts)]})
                    number, parts, size = number + 1, [], 0
        if parts:
            yield pd.DataFrame({"path": [f"{stem}-{number:05d}{suffix}"], "content": [b"".join(parts)]})

    return run


def write_archives(records: DataFrame, compress: bool = True, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, content): archives of about ``limit`` bytes; a longer record fills one alone."""
    # ids travel as text: pandas turns whole numbers with gaps into floats
    cols = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))
    return cols.mapInPandas(_write(compress, limit), "path string, content binary")


def digest_bytes(digest: str) -> tuple[str, bytes | None]:
    """(algorithm, bytes) of ``algorithm:value``; the value is hex, base32 or base64, as its length tells for the algorithm.
    None for an algorithm that is not known here, or a value that is none of the three."""
    name, _, value = digest.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    size = _SIZES.get(name)
    if size is None:
        return name, None
    plain = value.rstrip("=")
    try:
        if len(value) == 2 * size:
            return name, bytes.fromhex(value)
        if len(plain) == -(-8 * size // 5):
            return name, base64.b32decode(plain.upper() + "=" * (-len(plain) % 8))
        if len(plain) == -(-4 * size // 3):
            return name, base64.b64decode(plain.replace("-", "+").replace("_", "/") + "=" * (-len(plain) % 4), validate=True)
    except ValueError:
        pass
    return name, None


def agrees(digest: str, data: bytes) -> bool | None:
    """Whether a declared digest is that of ``data``; None if it can't be checked."""
    name, want = digest_bytes(digest)
    return None if want is None else hashlib.new(name, data, usedforsecurity=False).digest() == want


def _parse(data: bytes, at: int):
    """((fields, block, end), None) of the record at ``at``, or (None, reason)."""
    m = re.compile(rb"WARC/1\.\d\r?\n").match(data, at)
    if not m:
        return None, "no version line"
    # a header of any length, but none goes on after the next version line; lines end as the version line does
    eol = b"\r\n" if m[0].endswith(b"\r\n") else b"\n"
    limit = data.find(b"\nWARC/1.", m.end())
    stop = data.find(eol * 2, m.end() - len(eol), len(data) if limit < 0 else limit + 1)
    if stop < 0:
        return None, "header does not end"
    fields, name = {}, None
    for line in data[m.end() : stop].split(eol) if stop > m.end() else ():
        if line[:1] in (b" ", b"\t") and name:  # folded: goes on with the value of the line before
            fields[name] = (fields[name] + b" " + line.strip()).strip()
            continue
        name, colon, value = line.partition(b":")
        name = name.strip().lower()
        if not colon:
            return None, "bad header line"
        fields[name] = value.strip()
    if not _NEEDED <= fields.keys():
        return None, "a header line is missing"
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return None, "bad length"
    begin = stop + 2 * len(eol)
    end = begin + int(length)
    if end > len(data):
        return None, "record is cut off"
    block = data[begin:end]
    want = fields.get(b"warc-block-digest")
    if want and agrees(want.decode(errors="replace"), block) is False:
        return None, "block digest differs"
    tail = next((t for t in (b"\r\n\r\n", b"\n\n") if data.startswith(t, end)), None)
    if tail is None:
        return None, "record does not end"
    return (fields, block, end + len(tail)), None


def _plain(data: bytes, base: int):
    """Records and gaps of uncompressed WARC bytes; a gap ends at the next version line that parses."""
    at, bad, reason = 0, None, ""
    while at < len(data):
        got, why = _parse(data, at)
        if got:
            if bad is not None:
                yield "gap", (base + bad, base + at, reason)
                bad = None
            yield "record", (base + at, got[0], got[1])
            at = got[2]
            continue
        if bad is None:
            bad, reason = at, why
        nxt = data.find(b"WARC/1.", at + 1)
        at = len(data) if nxt < 0 else nxt
    if bad is not None:
        yield "gap", (base + bad, base + len(data), reason)


def _inflate(data: bytes, at: int):
    """(bytes, end, None) of the gzip member at ``at``; of a broken one (the bytes before the break, None, reason)."""
    d, out, view = zlib.decompressobj(31), [], memoryview(data)
    for i in range(at, len(data), _PIECE):
        before = d.copy()
        try:
            out.append(d.decompress(view[i : i + _PIECE]))
        except zlib.error:
            # the piece again byte by byte, as far as it goes
            try:
                for k in range(i, min(i + _PIECE, len(data))):
                    out.append(before.decompress(view[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(out), None, "gzip member is damaged"
        if d.eof:
            return b"".join(out), min(i + _PIECE, len(data)) - len(d.unused_data), None
    return b"".join(out), None, "gzip member is cut off"


def salvage(data: bytes):
    """("record", (offset, fields, block)) and ("gap", (start, end, reason)) of an archive, in order.

    What stands at a place decides how it is read: a gzip member or a plain record. After a failed check
    the reader looks for the next member or version line that is valid and goes on there; what it skips is
    a gap. Of a broken member of several records, those before the break are given, and the member is a gap.
    """
    at, bad, reason, marks = 0, None, "", dict.fromkeys((GZIP, b"WARC/1."), -1)
    while at < len(data):
        zipped = data[at : at + 3] == GZIP
        if zipped:
            out, end, why = _inflate(data, at)
            found = list(_plain(out, 0))
            if end is None:
                # without its checksum the last record is not known to be whole, unless more follows
                found = [x for x in found if x[0] == "record"] if len(found) > 1 else []
            some = any(kind == "record" for kind, _ in found)
            why = why or (None if some else "member holds no record")
            rows = [(kind, (at, *x[1:])) if kind == "record" else ("gap", (at, end, x[2])) for kind, x in found] if some else []
        else:
            got, why = _parse(data, at)
            rows, end = ([("record", (at, got[0], got[1]))], got[2]) if got else ([], None)
        if rows and bad is not None:
            yield "gap", (bad, at, reason)
            bad = None
        yield from rows
        if not why:
            at = end
            continue
        for mark, place in marks.items():
            if place <= at:
                place = data.find(mark, at + 1)
                marks[mark] = len(data) if place < 0 else place
        if bad is None:
            bad, reason = at, why if zipped or marks[b"WARC/1."] < len(data) or data[at : at + 7] == b"WARC/1." else "no gzip member"
        at = min(marks.values())
    if bad is not None:
        yield "gap", (bad, len(data), reason)


_READ = "path string, at bigint, until bigint, reason string, page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string, checked boolean"
_CHUNK = 64


def _page(urn: bytes):
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m else None


def _row(path, at, fields, block):
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get(b"warc-type", b"").decode()
    length = re.search(rb"(?i)content-length:\s*(\d+)", head)
    revisit = kind == "revisit"
    digest = hashlib.sha1(payload).hexdigest()
    if revisit:  # the payload is elsewhere: its declared SHA-1 as hex, any other digest as it stands
        declared = fields.get(b"warc-payload-digest", b"").decode(errors="replace")
        name, value = digest_bytes(declared)
        digest = value.hex() if name == "sha1" and value else declared
    block_digest = fields.get(b"warc-block-digest", b"").decode(errors="replace")
    checked = bool(block_digest) and agrees(block_digest, block) is True
    size = (int(length[1]) if length else None) if revisit else len(payload)
    ref = _page(fields.get(b"warc-refers-to", b""))
    return (path, at, None, None, _page(fields.get(b"warc-record-id", b"")), fields.get(b"warc-target-uri", b"").decode(errors="replace"), kind, ref, None if revisit else payload, size, digest, checked)


def _read(batches):
    names = [c.split()[0] for c in _READ.split(", ")]

    def frame(rows):
        whole = {"at", "until", "page_id", "refers_to", "payload_bytes"}
        return pd.DataFrame({c: pd.array([r[i] for r in rows], dtype="Int64") if c in whole else [r[i] for r in rows] for i, c in enumerate(names)})

    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = []
            for kind, x in salvage(bytes(content) if content is not None else b""):
                rows.append(_row(path, *x) if kind == "record" else (path, x[0], x[1], x[2], *[None] * 8))
                if len(rows) >= _CHUNK:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records (``reason`` is NULL) and quarantined gaps [at, until) with their reason, of (path, content).

    ``checked`` tells that a record's block digest was declared and is right; a record without one, or with one
    of an unknown algorithm or encoding, is kept unchecked. One that is wrong makes a gap.
    """
    return archives.select("path", "content").mapInPandas(_read, _READ)


def records(read: DataFrame) -> DataFrame:
    return read.filter("reason IS NULL").drop("until", "reason")


def gaps(read: DataFrame) -> DataFrame:
    return read.filter("reason IS NOT NULL").select("path", "at", "until", "reason")
