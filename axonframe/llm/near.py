"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

1. Every text becomes its set of word shingles (64-bit hashes) and a SuperMinHash signature: each
   shingle brings its own random permutation of the slots, one slot a step, so ranks of one shingle are
   correlated, every slot is hit evenly and the steps stop as soon as no slot can improve.
2. Equal sets are one class with one representative; only representatives go on.
3. Representatives that agree in a band share a bucket. Of each bucket the pivot (the member with most
   company over all its buckets) is compared with the others, never all pairs. Links are confirmed on
   the full sets, read again from the texts. Union-find groups what is linked.
4. Buckets whose members are then still in different groups are settled exactly: their members are
   joined on the rarest shingles that groups share (a prefix filter: two sets that are similar enough
   must share one of those), and pairs of different groups are confirmed in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import components, n_tasks, stored

BANDS, ROWS = 28, 5  # a pair at similarity 0.85 misses every band with probability 7e-8
BATCH_SHINGLES = 40_000
PARTNERS = 512  # texts that one copy of a pivot is compared with
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POLY = 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; A-Z are lower-cased, words end at 09-0D and space."""
    import xxhash

    w = text.encode().lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    step, n = np.uint64(_POLY), max(1, len(w) - width + 1)
    out = np.full(n, np.uint64(min(len(w), width)))
    for i in range(min(len(w), width)):
        out = out * step + h[i : i + n]
    return np.unique(_mix(out))


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash values (step and random part in one number) of non-empty sets, one row per set."""
    size = np.array([len(s) for s in sets])
    elem, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    best = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    perm = first = None
    for j in range(slots):
        bits = _mix(elem + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = j + ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(j) << np.uint64(32)) | (bits >> np.uint64(32))
        if j == 0:
            slot = first = k
        elif j == 1:  # the permutation so far is one swap
            slot = np.where(k == first, 0, k)
            if slots > 2:
                second = k
        else:
            at = np.arange(len(elem))
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.int16), (len(elem), 1))
                for step, to in ((0, first), (1, second)):
                    perm[at, step], perm[at, to] = perm[at, to], perm[at, step].copy()
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
        np.minimum.at(best, owner * slots + slot, value)
        # no later step can lower a slot that has a value of this step or an earlier one
        going = best.reshape(-1, slots).max(axis=1) >= (np.uint64(j + 1) << np.uint64(32))
        if not going.any():
            break
        live = going[owner]
        if not live.all():
            elem, owner, first = elem[live], owner[live], first[live]
            if j >= 1 and slots > 2:
                second = second[live]
            perm = None if perm is None else perm[live]
    return best.reshape(-1, slots)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (len(sig), 1))
    for r in range(rows):
        out = _mix(out ^ sig[:, r : bands * rows : rows]) + _GOLD
    return _mix(out).view(np.int64)


_SIGNED = "row bigint, doc_id bigint, text_md5 binary, n bigint, key binary, bands array<bigint>"
_EMPTY = np.empty(0, np.int64)


def _describe(bands: int, rows: int, width: int):
    names = [c.split()[0] for c in _SIGNED.split(", ")]

    def flush(head, sets):
        import xxhash

        full = [i for i, s in enumerate(sets) if len(s)]
        hashes = np.empty((0, bands), np.int64)
        if full:
            hashes = band_hashes(signatures([sets[i] for i in full], bands * rows), bands, rows)
        ends = np.zeros(len(sets) + 1, np.int32)
        ends[1:] = np.cumsum([bands if len(s) else 0 for s in sets])
        keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([*head, pa.array([len(s) for s in sets], pa.int64()), keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.ravel()))], names)

    def run(batches):
        for batch in batches:
            sets, held, begin = [], 0, 0
            for i, t in enumerate(batch.column(3)):
                s = shingles(t.as_py(), width)
                sets.append(s)
                held += len(s)
                if held >= BATCH_SHINGLES or i + 1 == batch.num_rows:
                    yield flush([batch.column(c).slice(begin, len(sets)) for c in range(3)], sets)
                    sets, held, begin = [], 0, i + 1

    return run


def _similar(percent: int, width: int):
    """Stream of rows sorted by pivot: the text of the pivot, then those it is compared with."""

    def run(batches):
        here, x = None, _EMPTY
        for batch in batches:
            a_ids, salts, b_ids = (batch.column(i).to_pylist() for i in range(3))
            good = []
            for i, (a, salt, b) in enumerate(zip(a_ids, salts, b_ids)):
                if b is None:
                    if (a, salt) != here:
                        here, x = (a, salt), shingles(batch.column(3)[i].as_py(), width)
                    continue
                y = shingles(batch.column(3)[i].as_py(), width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            if good:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(2).take(pa.array(good))], ["a", "b"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` is (rep, text).

    The partners of a pivot pass by its set in one sorted stream. A pivot with many partners has them
    dealt out over salts, each with a copy of its text, so no task sees them all.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")
    body = lambda side: texts.select(F.col("rep").alias(side), "text")
    one = load.join(body("a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "text")
    others = pairs.join(load, "a").select("a", salt, "b").join(body("b"), "b").select("a", "salt", "b", "text")
    stream = one.unionByName(others).repartition(n_tasks(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return stream.mapInArrow(_similar(percent, width), "a bigint, b bigint")


def _close(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _grouped(frame: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select(F.col("node").alias("rep"), "component")
    return frame.join(g, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _token_rows(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingles(t.as_py(), width).view(np.int64) for t in part.column(2)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["rep", "component", "sh"])

    return run


def _rest(members: DataFrame, groups: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Candidate pairs between different groups among the members of unsettled buckets."""
    m = _grouped(members, groups)
    unsettled = m.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    nodes = stored(m.join(unsettled, "bucket", "left_semi").select("rep", "component").distinct(), "near-unsettled")
    named = texts.join(nodes, "rep").select("rep", "component", "text")
    sets = stored(named.mapInArrow(_token_rows(width), "rep bigint, component bigint, sh array<bigint>"), "near-sets")
    tokens = sets.select("rep", "component", F.size("sh").alias("n"), F.explode("sh").alias("sh"))
    shared = tokens.groupBy("sh").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("sh", "df")
    # the global order puts shingles that no two groups share first; they can't link two groups
    order = tokens.join(shared, "sh").groupBy("rep", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sh"))).alias("s"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("s"))
    heads = order.withColumn("p", prefix.cast("int")).filter("p > 0").select("rep", "component", "n", (F.col("n") - F.size("s")).alias("before"), F.posexplode(F.slice("s", F.lit(1), F.col("p"))).alias("i", "x"))
    heads = stored(heads.select("rep", "component", "n", F.col("x.sh").alias("sh"), (F.col("n") - F.col("before") - F.col("i")).alias("rest")), "near-heads")
    # members of a shingle's main group meet only the others, so no group is paired with itself
    by_group = heads.groupBy("sh", "component").agg(F.count(F.lit(1)).alias("k"))
    main = by_group.groupBy("sh").agg(F.max(F.struct("k", "component")).alias("x"), F.count(F.lit(1)).alias("g")).filter("g > 1").select("sh", F.col("x.component").alias("main"))
    left = heads.join(main, "sh").filter("component <> main").select("sh", "main", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    right = heads.select("sh", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    # the first shingle two sets share bounds their intersection by what follows it in either order
    room = F.least("ra", "rb") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    meet = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & _close(F.col("na"), F.col("nb"), percent) & room
    return left.join(right, "sh").filter(meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, percent: int = 85, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_md5) per row of ``docs`` (doc_id, text).

    Two rows are linked if ``100 * intersection >= percent * union`` of their shingle sets; ``component_id`` is
    the smallest id that links reach. Texts without words have an empty set and no link. Rows are judged one by
    one, also those that repeat an id: equal ones alike, and a different text of the same id by its own links.
    Rows with a NULL id are never linked; their ``component_id`` is NULL and they are kept. Other columns are
    ignored; an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("text_md5"), text.alias("text"))
    sigs = stored(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_md5", "text").mapInArrow(_describe(bands, rows, width), _SIGNED), "near-signatures")
    named = sigs.filter("doc_id IS NOT NULL AND n > 0")
    # a class of equal sets goes on as one of its rows
    one = F.min(F.struct("row", "doc_id", "text_md5", "n", "bands")).alias("x")
    reps = stored(named.groupBy("key").agg(one, F.min("doc_id").alias("low")).select("key", "low", F.col("x.row").alias("rep"), "x.doc_id", "x.text_md5", "x.n", "x.bands"), "near-classes")
    at = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    sizes = at.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(at.join(sizes, "bucket"), "near-members")
    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    pivots = members.join(company, "rep").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("rep")).alias("neg"), "n")).alias("x"))
    star = members.join(pivots.select("bucket", (-F.col("x.neg")).alias("a"), F.col("x.n").alias("na")), "bucket")
    pairs = star.filter((F.col("a") != F.col("rep")) & _close(F.col("na"), F.col("n"), percent)).select("a", F.col("rep").alias("b")).distinct()
    # the texts move once, to the members of buckets; all later joins are on those few
    met = reps.select("rep", "doc_id", "text_md5").join(members.select("rep").distinct(), "rep", "left_semi")
    bodies = stored(texts.join(met.hint("merge"), ["doc_id", "text_md5"]).select("rep", "text"), "near-texts")
    links = stored(_verify(pairs, bodies, percent, width), "near-links")
    groups = components(links.toDF("u", "v"))
    more = stored(_verify(_rest(members, groups, bodies, percent, width), bodies, percent, width), "near-more")
    final = groups if more.isEmpty() else components(links.unionByName(more).toDF("u", "v"))
    of_rep = stored(_grouped(reps.select("key", "rep", "low"), final).select("key", "component", "low"), "near-grouped")
    least = of_rep.groupBy("component").agg(F.min("low").alias("component_id"))
    out = sigs.select("doc_id", "n", "key", "text_md5").join(of_rep.join(least, "component").select("key", "component_id"), "key", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_md5"
    )
