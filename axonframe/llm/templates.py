"""Benchmark decontamination on canonical templates.

Words are lower-cased and stripped of punctuation; numbers, units after numbers and names (capitals
inside a sentence) become typed placeholders, and their values slots. Documents and benchmark items meet
in an equi-join on the hashes of windows, in two readings. The literal one knows no placeholders, so a
verbatim copy is found whatever stands before it and in any letter case. The template one finds
re-parameterised copies: they have the same templates, and one value per slot. Where an item uses a value
twice, the copy must use one value twice as well. A run of names, and a number with its unit, is one
placeholder whatever its number of words, and windows of an item add up while they follow each other in the
item's order, also where words were put in or left out between them. A window with hardly a word is hashed together with the
nearest words of its text. A line break ends a sentence in one reading of a document and not in another.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import stored

WINDOW = 8
SHORTEST = 3  # items with fewer words have a literal reading only
TOGETHER = 1 << 18  # characters of texts that are read together
LITERALS = 2  # words (not placeholders) in a template's hash; windows with fewer are widened to reach so many
COVERAGE = 0.5  # share of an item's windows that makes a document contaminated
SLACK = 8  # words put in or left out between two windows of a copy that follow each other
BITMAP_BITS = 1 << 22  # fixed size of the filter that is sent to the tasks (512 KiB)
_BUCKET = 1 << 15  # bits in a bucket of Spark's bitmap aggregates

# Units that are placeholders after a number.
UNITS = frozenset("% $ kg g mg lb lbs oz t km m cm mm mi ft in l ml cl s sec h hr hrs min minutes hours days weeks months years usd eur dollars euros cents miles meters metres feet inches pounds kilograms grams liters litres degrees percent".split())
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th|[a-z%°]{1,3})?")
_EDGE = ".,;:!?\"'()[]{}<>…«»“”‘’"
_P = 0xD6E8FEB86659FD93


class Canon:
    """Words to canonical token hashes, with a bounded cache of word facts."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.facts: dict[str, int] = {}  # number of a word in the two lists
        self.hashes, self.kinds = array("Q"), array("b")

    def fact(self, word: str) -> int:
        """A new word: hash of the bare word, kind bits (1 number, 2 unit, 4 capital, 8 ends a sentence)."""
        import xxhash

        bare = word.strip(_EDGE) or word
        low = bare.lower()
        kind = (1 if _NUMBER.fullmatch(low) else 0) | (2 if low in UNITS else 0) | (4 if bare[:1].isupper() and not bare.isupper() else 0) | (8 if word.rstrip("\"')]»”’")[-1:] in ".!?:" else 0)
        self.facts[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(low))
        self.kinds.append(kind)
        return n

    def words(self, *texts: str) -> "Words":
        """The words of texts, one text after the other."""
        if len(self.facts) > 200_000:
            self._clear()
        get, fact = self.facts.get, self.fact
        numbers, starts, stops = [], [], []
        for text in texts:
            for line in text.splitlines():
                starts.append(len(numbers))
                numbers += [fact(w) if (k := get(w)) is None else k for w in line.split()]
            stops.append(len(numbers))
        at = np.array(numbers, np.int64)
        first = np.zeros(len(at) + 1, bool)
        first[starts] = True
        return Words(np.array(self.hashes, np.uint64)[at], np.array(self.kinds, np.int8)[at], first[:-1], np.array(stops, np.int64))

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(canonical token hashes, value hashes, is a slot) of a text."""
        t = template(self.words(text))
        return t.canon, t.value, t.slot


@dataclass
class Words:
    """Words of texts that stand one after the other; ``stops``: where each text ends."""

    bare: np.ndarray
    kind: np.ndarray
    first: np.ndarray  # begins a line
    stops: np.ndarray

    def begins(self) -> np.ndarray:
        """Per text, where it begins."""
        return np.concatenate([[0], self.stops[:-1]]).astype(np.int64)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Per word, where its text begins and ends."""
        low = self.begins()
        return np.repeat(low, self.stops - low), np.repeat(self.stops, self.stops - low)

    def of(self, texts: np.ndarray) -> "Words":
        """The words of some of the texts."""
        size = self.stops - self.begins()
        chosen = np.zeros(len(size), bool)
        chosen[texts] = True
        mine = np.repeat(chosen, size)
        return Words(self.bare[mine], self.kind[mine], self.first[mine], np.cumsum(size[texts]))


@dataclass
class Template:
    """Canonical tokens of texts that stand one after the other."""

    canon: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    capital: np.ndarray  # may be a name
    low: np.ndarray  # per token, where its text begins and ends
    high: np.ndarray

    def __post_init__(self):
        n = len(self.canon)
        self.sums = Sums(self.canon)
        self.word = np.flatnonzero(~self.slot)
        self.words_before = np.concatenate([[0], np.cumsum(~self.slot)])
        self.place = np.arange(n)
        self.slots_before = np.arange(n + 1) - self.words_before

    def windows(self, width: int, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, hash, first token whose value counts) of every template window.

        A window with fewer than ``LITERALS`` words is widened to the left until it has them, or else to the
        right; ``both`` gives the two where they exist (a document does not know where an item begins). A
        window that begins with a capital is also hashed as beginning with any capital, whose value is left out.
        """
        at = np.flatnonzero(self.place + width <= self.high)
        if not len(at):
            return at, np.empty(0, np.uint64), at
        after, before = self.words_before[at], self.words_before[at + width]
        thin = before - after < LITERALS
        wide = at[~thin]
        places, hashes = [wide], [_mixed(self.sums.of(wide, wide + width), width, width, 1)]
        if thin.any():
            t, after_t, before_t = at[thin], after[thin], before[thin]
            word = np.append(self.word, [len(self.canon)] * LITERALS)
            begin = word[before_t - LITERALS]
            left = (before_t >= LITERALS) & (begin >= self.low[t])
            end = word[after_t + LITERALS - 1] + 1
            right = end <= self.high[t]
            if not both:
                right &= ~left
            for keep, b, e, family in ((left, begin, t + width, 2), (right, t, end, 3)):
                places.append(t[keep])
                hashes.append(_mixed(self.sums.of(b[keep], e[keep]), width, e[keep] - b[keep], family))
        a = at[self.capital[at] & (before - self.words_before[at + 1] >= LITERALS)]
        hashes.append(_mixed(self.sums.of(a, a + width) - self.canon[a], width, width, 4))
        place = np.concatenate([*places, a])
        return place, np.concatenate(hashes), np.concatenate([*places, a + 1])

    def values(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot values of stretches one after the other, how many each has)."""
        first, n = self.slots_before[begin], self.slots_before[end] - self.slots_before[begin]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return self.value[np.flatnonzero(self.slot)[at]].view(np.int64), n


def template(words: Words, lines: bool = True) -> Template:
    """Tokens of words; with ``lines``, a line break ends a sentence.

    A run of names is one token, as is a number with its unit; its value is that of the whole run.
    """
    bare, kind = words.bare, words.kind
    low, high = words.spans()
    if not len(bare):
        return Template(bare, bare, np.empty(0, bool), np.empty(0, bool), low, high)
    begins = np.arange(len(bare)) == low
    number = (kind & 1) > 0
    unit = ((kind & 2) > 0) & np.concatenate([[False], number[:-1]]) & ~begins
    capital = ((kind & 4) > 0) & ~number & ~unit
    name = capital & np.concatenate([[False], (kind[:-1] & 8) == 0]) & ~(words.first if lines else begins) & ~begins
    canon = np.where(number, np.uint64(1), np.where(name, np.uint64(3), bare))
    joined = unit | (name & np.concatenate([[False], name[:-1]]))
    begin = np.flatnonzero(~joined)
    length = np.diff(np.append(begin, len(bare)))
    value = bare[begin]
    longer = np.flatnonzero(length > 1)
    k = 1
    while len(longer):
        value[longer] = value[longer] * np.uint64(_P) + bare[begin[longer] + k]
        k += 1
        longer = longer[length[longer] > k]
    token = np.cumsum(~joined) - 1
    edge = np.append(token, len(begin))
    return Template(canon[begin], value, (number | name)[begin], capital[begin], edge[low[begin]], edge[high[begin]])


class Sums:
    """Hashes of any stretch of a token sequence, from running sums of a polynomial."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, tokens: np.ndarray):
        n = len(tokens) + 1
        if n > len(Sums.up):
            powers = lambda base: np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, np.uint64(base)))])
            Sums.up, Sums.down = powers(_P), powers(pow(_P, -1, 1 << 64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * Sums.down[: n - 1])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * Sums.up[begin]


def _mixed(h: np.ndarray, width: int, length: np.ndarray | int, family: int) -> np.ndarray:
    tail = np.asarray(length).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 % 2**63) + np.uint64(width << 8 | family)
    h = h * np.uint64(_P)
    h += tail
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def literal_windows(words: Words, width: int, sums: Sums | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every window of words."""
    high = words.spans()[1] if high is None else high
    at = np.flatnonzero(np.arange(len(high)) + width <= high)
    return at, _mixed((sums or Sums(words.bare)).of(at, at + width), width, width, 0)


_ITEM = "item_id bigint, reading int, at int, h bigint, slots array<bigint>, width int, n_windows int"


def _item_windows(window: int, shortest: int):
    def run(batches):
        canon = Canon()
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["item_id"], pdf["text"]):
                words = canon.words(t if isinstance(t, str) else "")
                width = min(window, len(words.bare))
                if not width:
                    continue
                at, h = literal_windows(words, width)
                rows += [(int(i), 0, a, x, [], width, len(at)) for a, x in zip(at.tolist(), h.view(np.int64).tolist())]
                tokens = template(words)
                width = min(window, len(tokens.canon))
                if width < shortest:
                    continue
                at, h, begin = tokens.windows(width, both=False)
                values, n = tokens.values(begin, at + width)
                slots = np.split(values, np.cumsum(n)[:-1])
                count = len(np.unique(at))
                rows += [(int(i), 1, a, x, v.tolist(), width, count) for a, x, v in zip(at.tolist(), h.view(np.int64).tolist(), slots)]
            yield pd.DataFrame(rows, columns=["item_id", "reading", "at", "h", "slots", "width", "n_windows"])

    return run


_DOC = "doc_id bigint, row string, reading int, at int, h bigint, slots array<bigint>"


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Key of a row by id and text; rows with equal keys are equal for this operator."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    i = F.col(doc_id).cast("bigint")
    return F.concat_ws("-", F.hex(F.xxhash64(i, t)), F.hex(F.xxhash64(t, i, F.lit("row"))))


def _doc_windows(literal: list[int], templates: list[int], bitmap: bytes):
    names = [c.split()[0] for c in _DOC.split(", ")]

    def batch(doc_id, row, reading=None, at=None, h=None, slots=None, n=None):
        k = len(doc_id)
        none = [pa.nulls(k, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
        if reading is not None:
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            none = [pa.array(np.full(k, reading, np.int32)), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(slots))]
        return pa.RecordBatch.from_arrays([doc_id, row, *none], names)

    def run(batches):
        canon, bits = Canon(), np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)
        known = lambda h: np.flatnonzero(bits[(h & np.uint64(BITMAP_BITS - 1)).view(np.int64)])

        def hits(part, texts):
            """Windows of the texts of ``part`` that some item may have, by reading."""

            def give(reading, place, low, at, h, slots, n):
                text = pa.array(place)
                return batch(part.column(0).take(text), part.column(1).take(text), reading, at - low, h, slots, n)

            words = canon.words(*texts)
            low, high = words.spans()
            size = words.stops - words.begins()
            text_of = np.repeat(np.arange(len(texts)), size)
            sums = Sums(words.bare)
            for width in literal:
                at, h = literal_windows(words, width, sums, high)
                k = known(h)
                if len(k):
                    yield give(0, text_of[at[k]], low[at[k]], at[k], h[k], np.empty(0, np.int64), np.zeros(len(k), np.int64))
            # a line break ends a sentence in reading 1, and is a blank in reading 2
            kind, first = words.kind, words.first
            differs = np.flatnonzero(first[1:] & ((kind[1:] & 4) > 0) & ((kind[:-1] & 8) == 0) & (text_of[1:] == text_of[:-1])) + 1
            some = np.unique(text_of[differs])
            readings = [(1, np.arange(len(texts)), template(words))]
            if len(some):
                readings.append((2, some, template(words.of(some), lines=False)))
            for reading, numbers, tokens in readings:
                # where each text's tokens begin tells a token's text
                begins, which = np.unique(tokens.low, return_inverse=True)
                named = np.zeros(len(begins), np.int64)
                filled = numbers[size[numbers] > 0]
                named[: len(filled)] = filled
                for width in templates:
                    at, h, begin = tokens.windows(width, both=True)
                    k = known(h)
                    if len(k):
                        a = at[k]
                        values, n = tokens.values(begin[k], a + width)
                        yield give(reading, named[which[a]], tokens.low[a], a, h[k], values, n)

        for whole in batches:
            texts, held, begin = [], 0, 0
            for i, t in enumerate(whole.column(2)):
                texts.append(t.as_py() or "")
                held += len(texts[-1])
                if held >= TOGETHER or i + 1 == whole.num_rows:
                    part = whole.slice(begin, len(texts))
                    yield batch(part.column(0), part.column(1))
                    yield from hits(part, texts)
                    texts, held, begin = [], 0, i + 1

    return run


def item_windows(benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """Literal (reading 0) and template windows (1) of the items; an item shorter than ``window`` is one window.

    Items of fewer than ``shortest`` tokens are searched for literally only: their templates say nothing.
    """
    return benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInPandas(_item_windows(window, shortest), _ITEM)


def bitmap_of(windows: DataFrame) -> bytes:
    """One bit per hash modulo ``BITMAP_BITS``; its size does not depend on the benchmark."""
    at = F.col("h").bitwiseAND(F.lit(BITMAP_BITS - 1))
    parts = windows.groupBy(F.floor(at / _BUCKET).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(_BUCKET))).alias("bits")).collect()
    out = bytearray(BITMAP_BITS // 8)
    for b, bits in parts:
        out[b * _BUCKET // 8 : b * _BUCKET // 8 + len(bits)] = bits
    return bytes(out)


def _chain(points: dict[int, list[int]], size: int) -> list[tuple[int, int]]:
    """The longest chain of (document place, item place), rising in both.

    Between neighbours the distance in the document differs by at most ``SLACK`` from that in the item.
    """
    length, last, node = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
    places, nodes, best = np.arange(size), [], (0, -1)
    for d in sorted(points):
        new = []
        for a in points[d]:
            lag = d - last[:a]
            fits = (length[:a] > 0) & (np.abs(lag - (a - places[:a])) <= SLACK)
            k = int(np.argmax(np.where(fits, length[:a], 0))) if a else 0
            n, before = (int(length[k]) + 1, int(node[k])) if a and fits[k] else (1, -1)
            new.append((a, n, len(nodes)))
            nodes.append((d, a, before))
            best = max(best, (n, len(nodes) - 1))
        for a, n, i in new:
            if n >= length[a] or d - last[a] > size + SLACK:
                length[a], last[a], node[a] = n, d, i
    out, i = [], best[1]
    while i >= 0:
        d, a, i = nodes[i]
        out.append((d, a))
    return out


def covered(met, n_windows: int, coverage: float) -> float:
    """Share of an item's windows in the longest sound chain of a document; 0 below ``coverage``.

    ``met``: per hash, its places in the document and in the item, with slots. A chain is sound if no item
    value stands for two document values. One that is not is set aside as a whole, and the rest searched
    on; every single shift is tried as well.
    """
    pairs: dict[tuple[int, int], set] = {}
    for x in met:
        for hit in x["hits"]:
            for place in x["places"]:
                pairs.setdefault((int(hit["d_at"]), int(place["at"])), set()).update(zip(map(int, place["slots"]), map(int, hit["d_slots"])))

    def sound(chain):
        both = set().union(*(pairs[p] for p in chain))
        return len(both) == len({i for i, _ in both})

    share = lambda n: n / n_windows if n / n_windows >= coverage else 0.0
    size, left, best = 1 + max(a for _, a in pairs), set(pairs), 0
    while len({a for _, a in left}) > best and share(len(left)):
        points: dict[int, list[int]] = {}
        for d, a in left:
            points.setdefault(d, []).append(a)
        chain = _chain(points, size)
        if len(chain) <= best or not share(len(chain)):
            break
        if sound(chain):
            best = len(chain)
            break
        left -= set(chain)
    shifts: dict[int, list] = {}
    for d, a in pairs:
        shifts.setdefault(d - a, []).append((d, a))
    best = max([best, *(len(c) for c in shifts.values() if len(c) > best and share(len(c)) and sound(c))])
    return share(best) if best else 0.0


def _chained(coverage: float):
    def run(batches):
        for pdf in batches:
            rows = []
            for row, reading, item, n, met in zip(pdf["row"], pdf["reading"], pdf["item_id"], pdf["n_windows"], pdf["met"]):
                share = covered(met, int(n), coverage)
                if share:
                    rows.append((row, item, share, bool(reading == 0)))
            yield pd.DataFrame(rows, columns=["row", "item_id", "share", "same"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, n_items, item_id, coverage, exact, kept, row: its key) per row of ``docs`` (doc_id, text).

    An item is found in a document if at least ``coverage`` of its windows stand there in the item's own
    order, at its distances up to ``SLACK`` words, and no item value stands for two document values. ``item_id`` is the best
    covered one (smallest id of equal ones), ``exact`` tells a literal copy from a re-parameterised one:
    the literal reading covers as much of the item as any template reading.
    ``kept`` is false for documents with an item. NULL and empty texts hold no item; rows equal in id and
    text are judged once and returned as often as they come. Empty tables give empty or clean results.
    """
    items = stored(item_windows(benchmark), "bench-windows")
    widths = items.select("reading", "width").distinct().collect()  # at most WINDOW values a reading
    literal, templates = (sorted(w for r, w in widths if r == k) for k in (0, 1))
    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), F.col("text").cast("string").alias("text"))
    found = stored(body.mapInArrow(_doc_windows(literal, templates, bitmap_of(items)), _DOC), "bench-hits")
    rows = found.filter("at IS NULL").select("doc_id", "row")
    hits = found.filter("at IS NOT NULL").select("row", "reading", F.col("at").alias("d_at"), "h", F.col("slots").alias("d_slots")).distinct()
    # a row per item and hash, so that an item of repeated windows does not multiply the hits
    places = items.groupBy("item_id", "h").agg(F.collect_list(F.struct("at", "slots")).alias("places"), F.first("n_windows").alias("n_windows"))
    met = hits.join(places, "h").groupBy("row", "reading", "item_id", "h").agg(
        F.collect_list(F.struct("d_at", "d_slots")).alias("hits"), F.first("places").alias("places"), F.first("n_windows").alias("n_windows")
    )
    met = met.groupBy("row", "reading", "item_id").agg(F.first("n_windows").alias("n_windows"), F.collect_list(F.struct("hits", "places")).alias("met"))
    # no chain has more windows than the item has places with these hashes
    met = met.filter(F.aggregate("met", F.lit(0), lambda n, x: n + F.size(x["places"])) >= coverage * F.col("n_windows"))
    good = met.mapInPandas(_chained(coverage), "row string, item_id bigint, share double, same boolean")
    best = good.groupBy("row", "item_id").agg(F.max(F.struct("share", "same")).alias("b"))
    per_doc = best.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.max(F.struct("b.share", (-F.col("item_id")).alias("neg"), "b.same")).alias("b"))
    out = rows.join(per_doc, "row", "left")
    return out.select(
        "doc_id", F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), (-F.col("b.neg")).alias("item_id"), F.coalesce("b.share", F.lit(0.0)).alias("coverage"),
        F.coalesce("b.same", F.lit(False)).alias("exact"), F.col("n_items").isNull().alias("kept"), "row",
    )
