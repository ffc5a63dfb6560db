"""Alignment of two tokenizers by interval coalescing, and corpus-wide link counts.

Tokens of both vocabularies are byte intervals of the same text. All of them are sorted by start, a running
maximum of their ends is kept, and a group breaks where a start reaches that maximum. Both sides tile the
text, so inside a group every token but the first meets the newest token of the other side: that is a link.

Words with the blanks before them are encoded once per worker and looked up after that; no token of either
vocabulary crosses from a word to a blank or line break after it (checked on the vocabulary), so the tokens
of a text are those of its words one after the other. Texts are handled in slices of bounded size.

Link counts: pairs with at least ``1 / FREQUENT`` of all links (at most ``FREQUENT`` can exist) are sent to
the tasks; the links of all others meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import stored

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE = 1 << 18  # characters handled together
CACHED = 500_000  # words a worker remembers
FREQUENT = 1 << 17

# Characters of White_Space (Unicode), which byte-level patterns treat as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
MARK = "▁"  # SentencePiece's blank

STATS = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, a array<int>, b array<int>, m array<int>"


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary to its byte: printable bytes stand for themselves, the others
    follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Token ids of pieces under both vocabularies, and the bytes of every id."""

    def __init__(self, folder: str = FOLDER, byte_level: str = BYTE_LEVEL, pieces: str = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(f"{folder}/{byte_level}")
        self.first.encode_special_tokens = True
        vocabulary = self.first.get_vocab(with_added_tokens=True)
        of = byte_alphabet()
        a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.second = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{pieces}")
        ids = range(self.second.vocab_size())
        name = self.second.id_to_piece
        b = [bytes([int(name(i)[3:-1], 16)]) if self.second.is_byte(i) else name(i).replace(MARK, " ").encode() for i in ids]
        self.bytes = a, b
        self.lengths = tuple(np.array([len(x) for x in t], np.int64) for t in self.bytes)
        # byte-level patterns end a word at white space; pieces may hold some kinds of it after a word
        kind = json.loads(self.first.to_str())["pre_tokenizer"] or {}
        crossed = {name(i)[k : k + 2].replace(MARK, " ") for i in ids for k in range(len(name(i)) - 1)}
        opens = "".join(c for c in " \n" if not any(x[1] == c and (x[0] not in WHITE or x == " \n") for x in crossed))
        self.split = kind.get("type") == "ByteLevel" and " " in opens
        rest = "".join(c for c in WHITE if c not in opens)
        self.piece = re.compile(f"[{WHITE}]*[^{WHITE}]+(?:[{rest}][{WHITE}]*[^{WHITE}]+)*(?:[{rest}][{WHITE}]*\\Z)?|[{WHITE}]+")
        self.cut = re.compile(f"(?<=[^{WHITE}])(?=[{opens}])")
        self.blank = self.second.piece_to_id(MARK)
        self.text = [b"%d%s" % (i, end) for t, ends in zip(self.bytes, ((b",", b"|"), (b",", b";"))) for end in ends for i in range(len(t))]
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.sound = np.empty(0, bool)
        self.tables = _Table(), _Table()

    def pieces(self, text: str) -> list[str]:
        return self.piece.findall(text) if self.split else [text]

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts of about ``SLICE`` characters, cut between pieces."""
        at = 0
        while self.split and len(text) - at > SLICE and (m := self.cut.search(text, at + SLICE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _encode(self, words: list[str], raw: list[bytes]) -> tuple[list, list]:
        """Per side, the ids of all words in one array and how many each has."""
        if self.split:  # words that end in a blank would run into the next one
            joined = self.first.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids
            ends = np.cumsum(self.lengths[0][joined])
            cuts = np.searchsorted(ends, np.cumsum([len(r) for r in raw]), "right")
            a = [np.array(joined, np.int32), np.diff(cuts, prepend=0)]
        else:
            a = _flat([e.ids for e in self.first.encode_batch_fast(words, add_special_tokens=False)])
        # the library puts a blank before each word: it stands for the word's own, or is taken off again
        ids = self.second.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        for i, w in enumerate(words):
            if w == " ":
                ids[i] = [self.blank]
            elif w[0] != " ":
                ids[i] = ids[i][1:]
        return a, _flat(ids)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        both = self._encode(words, raw)
        sound, text = np.ones(len(words), bool), b"".join(raw)
        for side, (ids, n) in enumerate(both):
            of, size = self.bytes[side], self.lengths[side][ids]
            stop = np.append(0, np.cumsum(size))[np.cumsum(n)]
            if not (stop == np.cumsum([len(r) for r in raw])).all() or b"".join(map(of.__getitem__, ids.tolist())) != text:
                cut = np.split(ids, np.cumsum(n)[:-1])
                sound &= np.array([b"".join(map(of.__getitem__, x.tolist())) == r for x, r in zip(cut, raw)])
            self.tables[side].add(ids, n)
        self.seen.update(zip(words, range(len(self.sound), len(self.sound) + len(words))))
        self.sound = np.concatenate([self.sound, sound])

    def lookup(self, words: list[str]) -> np.ndarray:
        """Numbers of words; those not seen yet are encoded."""
        found = list(map(self.seen.get, words))
        new = list(dict.fromkeys(w for w, k in zip(words, found) if k is None))
        if new and len(self.seen) + len(new) > CACHED:
            self._clear()
            new = list(dict.fromkeys(words))
        if new:
            last = [w for w in new if w[-1] in WHITE]
            for group in [[w for w in new if w[-1] not in WHITE], *([w] for w in last)]:
                if group:
                    self._learn(group)
            found = map(self.seen.__getitem__, words)
        return np.fromiter(found, np.int64, len(words))

    def tokens(self, numbers: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many per word)."""
        table = self.tables[side]
        n = table.size[numbers]
        at = np.repeat(table.begin[numbers] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return table.ids[at], n


class _Table:
    """Arrays of ids under consecutive numbers; room grows by doubling."""

    def __init__(self):
        self.ids, self.begin, self.size = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = self.words = 0

    def add(self, ids: np.ndarray, n: np.ndarray) -> None:
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.size) < self.words + len(n):
            self.begin, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        here = slice(self.words, self.words + len(n))
        self.size[here], self.begin[here] = n, self.used + np.cumsum(n) - n
        self.used, self.words = self.used + len(ids), self.words + len(n)


def _flat(lists: list[list[int]]) -> list[np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return [np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum())), n]


def coalesce(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two tilings of the same bytes, given by the ends of their tokens.

    Returns (group of each A token, group of each B token, A index of each link, B index of each link).
    """
    n = len(a_end)
    ends = np.concatenate([a_end, b_end])
    starts = np.concatenate([[0], a_end[:-1], [0], b_end[:-1]])[: len(ends)] if n else ends
    side = np.repeat([0, 1], [n, len(b_end)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.cumsum(breaks) - 1
    second = side[order] == 1
    newest_b = np.cumsum(second) - 1
    newest_a = np.arange(len(order)) - newest_b - 1
    return group[~second], group[second], newest_a[~breaks], newest_b[~breaks]


def _aligned(codec: Codec, parts: list[str], digest: bool):
    """Per part: n_a, n_b, n_groups, n_links, text of the groups (or None), and its distinct links with counts."""
    lists = [codec.pieces(p) for p in parts]
    counts = np.array([len(x) for x in lists])
    numbers = codec.lookup([p for x in lists for p in x])
    part_of = np.repeat(np.arange(len(parts)), counts)
    sound = np.ones(len(parts), bool)
    sound[part_of[~codec.sound[numbers]]] = False
    good = sound[part_of]
    numbers, part_of = numbers[good], part_of[good]
    (a, per_a), (b, per_b) = codec.tokens(numbers, 0), codec.tokens(numbers, 1)
    part_a, part_b = np.repeat(part_of, per_a), np.repeat(part_of, per_b)
    ga, gb, la, lb = coalesce(np.cumsum(codec.lengths[0][a]), np.cumsum(codec.lengths[1][b]))
    k = len(parts)
    n_groups = int(ga[-1]) + 1 if len(ga) else 0
    size_a, size_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    before_a, before_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    va, vb = len(codec.lengths[0]), len(codec.lengths[1])
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + before_b[ga]] = a + va * np.append(ga[1:] != ga[:-1], True)[: len(a)]
    code[np.arange(len(b)) + (before_a + size_a)[gb]] = b + 2 * va + vb * np.append(gb[1:] != gb[:-1], True)[: len(b)]
    n_a, n_b = np.bincount(part_a, minlength=k), np.bincount(part_b, minlength=k)
    groups_in = np.bincount(part_a[np.flatnonzero(np.append(True, ga[1:] != ga[:-1])[: len(a)])], minlength=k)
    key, times = np.unique((part_a[la].astype(np.int64) * va + a[la]) * vb + b[lb], return_counts=True)
    of_part = np.searchsorted(key, np.arange(k + 1) * va * vb)
    stop = np.cumsum(n_a + n_b)
    for i in range(k):
        text = b"".join(map(codec.text.__getitem__, code[stop[i] - n_a[i] - n_b[i] : stop[i]].tolist()))[:-1] if sound[i] else None
        links = slice(of_part[i], of_part[i + 1])
        yield int(n_a[i]), int(n_b[i]), int(groups_in[i]), int(n_a[i] + n_b[i] - groups_in[i]), text, key[links] % (va * vb), times[links]


class _Document:
    """Results of the parts of one text."""

    def __init__(self, row: int, doc_id, digest: bool):
        self.head, self.digest, self.sound = (row, doc_id), digest, True
        self.n, self.texts, self.hash, self.links = np.zeros(4, np.int64), [], hashlib.sha256(), []

    def add(self, n_a, n_b, n_groups, n_links, text, links, times) -> None:
        if text is None or not self.sound:
            self.sound = False
            self.n[:], self.texts, self.links = 0, [], []
            return
        if self.digest:
            self.hash.update(b";" + text if self.n[0] else text)
        else:
            self.texts.append(text)
        self.n += (n_a, n_b, n_groups, n_links)
        self.links.append((links, times))

    def result(self) -> tuple:
        if len(self.links) > 1:
            key, at = np.unique(np.concatenate([x for x, _ in self.links]), return_inverse=True)
            self.links = [(key, np.bincount(at, np.concatenate([t for _, t in self.links])).astype(np.int64))]
        key, times = self.links[0] if self.links else (np.empty(0, np.int64), np.empty(0, np.int64))
        groups = "" if not self.n[0] else self.hash.hexdigest() if self.digest else b";".join(self.texts).decode()
        return *self.head, *map(int, self.n), groups, key, times


def _batch(rows: list[tuple], vb: int) -> pa.RecordBatch:
    sizes = np.cumsum([0, *(len(r[7]) for r in rows)]).astype(np.int32)
    key, times = np.concatenate([r[7] for r in rows]), np.concatenate([r[8] for r in rows])
    lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(x.astype(np.int32))) for x in (key // vb, key % vb, times)]
    flat = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)] + [pa.array([r[6] for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays(flat + lists, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "m"])


def _codec(files: tuple[str, str, str]) -> Codec:
    """The worker's codec; kept beside the library, because functions are pickled anew for every task."""
    import sentencepiece

    held = sentencepiece.__dict__.setdefault("codecs_by_file", {})
    if files not in held:
        held[files] = Codec(*files)
    return held[files]


def _align(files: tuple[str, str, str], digest: bool):
    def run(batches):
        codec = _codec(files)
        vb = len(codec.lengths[1])
        held, waiting, size = [], [], 0

        def flush():
            nonlocal held, waiting, size
            for doc, result in zip(waiting, _aligned(codec, held, digest) if held else ()):
                doc.add(*result)
            held, waiting, size = [], [], 0

        for batch in batches:
            out = []
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                doc = _Document(row, doc_id, digest)
                out.append(doc)
                if t := text.as_py():
                    for part in codec.parts(" " + t):
                        held.append(part)
                        waiting.append(doc)
                        size += len(part)
                        if size >= SLICE:
                            flush()
                            if len(out) > 1:
                                yield _batch([d.result() for d in out[:-1]], vb)
                                out = [doc]
            flush()
            if out:
                yield _batch([d.result() for d in out], vb)

    return run


def alignments(docs: DataFrame, folder: str = FOLDER, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, digest: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, a, b, m) per row of ``docs`` (doc_id, text).

    ``groups`` reads ``a1,a2|b1;a3|b2,b3`` (ids in order), or its SHA-256 with ``digest``; ``a``, ``b``, ``m`` are
    the distinct linked ids of the document and how often they are linked. Texts that are NULL or empty, or
    that a vocabulary does not give back byte for byte, have no tokens: zeros and an empty ``groups``.
    Other columns are ignored; rows that repeat are judged one by one; an empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_align((folder, byte_level, pieces), digest), STATS)


def link_counts(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum) of every row of ``aligned`` that has links.

    A pair's count is how many links of the corpus hold it; ``n_best`` counts the links whose pair has its B
    id's highest count (ties included), ``count_sum`` adds the counts of all links.
    """
    links = aligned.select("row", F.explode(F.arrays_zip("a", "b", "m")).alias("x")).select("row", "x.a", "x.b", "x.m")
    counts = stored(links.groupBy("a", "b").agg(F.sum("m").alias("n")), "align-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # a row per B id: bounded by the vocabulary
    pairs = stored(counts.join(F.broadcast(top), "b").select("a", "b", "n", (F.col("n") == F.col("top")).cast("int").alias("best")), "align-pairs")
    least = max(1, -(-(pairs.agg(F.sum("n")).first()[0] or 0) // frequent))
    # at most `frequent` pairs can hold 1 / frequent of the links each: a proven bound for the broadcast
    common = F.broadcast(pairs.filter(F.col("n") >= least))
    rare = pairs.filter(F.col("n") < least)
    total = (F.sum(F.col("m") * F.col("best")).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    met = links.join(common, ["a", "b"]).groupBy("row").agg(*total)
    rest = links.join(common.select("a", "b"), ["a", "b"], "left_anti").join(rare.hint("merge"), ["a", "b"]).groupBy("row").agg(*total)
    return met.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, folder: str = FOLDER, digest: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row; see :func:`alignments`."""
    aligned = stored(alignments(docs, folder, digest=digest), "align-rows")
    sums = link_counts(aligned, frequent)
    zero = F.lit(0).cast("bigint")
    return aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums.hint("merge"), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups"
    )
