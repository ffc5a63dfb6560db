"""Hard negatives through a multiway tree of hyperplanes with distance ranges.

Inner products become distances by one more coordinate: a row ``x`` is lifted to ``(x, sqrt(M - |x|^2))`` with
the largest squared norm ``M``, an anchor to ``(q, 0)``; then ``d^2 = |q|^2 + M - 2 q.x`` and a window of scores
is an annulus around the anchor. Every node of the tree has split points; a row belongs to the nearest one
(the hyperplanes between them bound the subtrees), and every split point stores the range of its distances
to the rows of each sibling subtree. A subtree is left out if, for any split point, its range does not meet
what the annulus allows.

The tree is fitted on a bounded sample, which also gives every anchor a first bound on its worst result;
all rows are put into leaves and all ranges come from all rows. Leaves are cut into blocks of bounded
size by id. Rows of a block and the anchors that have to see it meet in one sorted stream: the block is
held, the anchors pass by, and scores are exact integers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonframe.llm.common import n_tasks, stored

SAMPLE = 4096  # rows the tree is fitted on
FANOUT = 8  # split points of a node
DEEPEST = 4  # levels: at most FANOUT ** DEEPEST leaves
LEAF_ROWS = 16_384  # rows a leaf should have; fuller ones are cut into blocks of about so many
ANCHORS = 1 << 20  # anchors that one task sees at most; more are dealt to copies of the block
SLICE = 128  # anchors scored at once
SCALE = 256.0
LONG = float(1 << 63)


@dataclass
class Tree:
    """Split points per node; ``child`` is the next node, or ``-1 - leaf``."""

    top: float  # largest squared norm
    split: list[np.ndarray] = field(default_factory=list)
    lift: list[np.ndarray] = field(default_factory=list)
    child: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0
    low: list[np.ndarray] = field(default_factory=list)  # per node: split point x subtree
    high: list[np.ndarray] = field(default_factory=list)

    def heights(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", x, x), 0))

    def distances(self, node: int, x: np.ndarray, height: np.ndarray) -> np.ndarray:
        """Rows (lifted) to the split points of a node."""
        return np.sqrt(np.maximum(2 * (self.top - x @ self.split[node].T - np.outer(height, self.lift[node])), 0))

    def reach(self, node: int, q: np.ndarray) -> np.ndarray:
        """Anchors to the split points of a node."""
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q)[:, None] + self.top - 2 * (q @ self.split[node].T), 0))

    def route(self, x: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
        """(leaf of every row, per node and subtree the least and largest distance to each split point)."""
        leaf, height, ranges = np.zeros(len(x), np.int32), self.heights(x), {}
        waiting = [(0, np.arange(len(x)))] if self.split else []
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            d = self.distances(node, x[rows], height[rows])
            near = d.argmin(axis=1)
            for j, nxt in enumerate(self.child[node]):
                mine = near == j
                if not mine.any():
                    continue
                ranges[node, j] = d[mine].min(axis=0), d[mine].max(axis=0)
                if nxt < 0:
                    leaf[rows[mine]] = -1 - nxt
                else:
                    waiting.append((int(nxt), rows[mine]))
        return leaf, ranges

    def alive(self, q: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> list[list[int]]:
        """Leaves of every anchor that may hold rows at a distance from ``inner`` to ``outer``; both have a
        column per window, and a leaf counts if any window meets it."""
        out: list[list[int]] = [[] for _ in range(len(q))]
        slack = 1e-6 * (1 + np.sqrt(self.top))
        waiting = [(0, np.arange(len(q)))] if self.split else []
        if not self.split:
            return [[0]] * len(q)
        while waiting:
            node, rows = waiting.pop()
            d = self.reach(node, q[rows])[:, :, None, None]  # anchor, split point, subtree, window
            near, far = inner[rows][:, None, None, :] - slack, outer[rows][:, None, None, :] + slack
            low, high = self.low[node][None, :, :, None], self.high[node][None, :, :, None]
            meets = (low <= d + far) & (high >= d - far) & (high >= near - d) & (far >= near)
            seen = meets.all(axis=1).any(axis=2)
            for j, nxt in enumerate(self.child[node]):
                mine = rows[seen[:, j]]
                if not len(mine):
                    continue
                if nxt < 0:
                    for r in mine:
                        out[r].append(int(-1 - nxt))
                else:
                    waiting.append((int(nxt), mine))
        return out


def fit(sample: np.ndarray, top: float, levels: int, fanout: int = FANOUT) -> Tree:
    """A tree on sample rows; split points of a node are far from each other."""
    tree = Tree(top)
    height = tree.heights(sample)

    def grow(rows: np.ndarray, level: int) -> int:
        x, h = sample[rows], height[rows]
        chosen, nearest = [], np.full(len(rows), np.inf)
        at = 0
        while len(chosen) < min(fanout, len(rows)) and nearest[at] > 0:
            chosen.append(at)
            nearest = np.minimum(nearest, np.maximum(2 * (top - x @ x[at] - h * h[at]), 0))
            nearest[chosen] = 0
            at = int(nearest.argmax())
        if level == 0 or len(chosen) < 2:
            tree.leaves += 1
            return -tree.leaves
        node = len(tree.split)
        tree.split.append(x[chosen])
        tree.lift.append(h[chosen])
        tree.child.append(np.zeros(len(chosen), np.int64))
        near = tree.distances(node, x, h).argmin(axis=1)
        for j in range(len(chosen)):
            tree.child[node][j] = grow(rows[near == j], level - 1)
        return node

    if len(sample):
        grow(np.arange(len(sample)), levels)
    tree.leaves = max(tree.leaves, 1)
    return tree


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of one matrix, short ones padded with zeros."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), dims))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, one row per row of ``a``.

    Every partial sum is below the product of the norms, which tells whether a float type holds them all.
    """
    bound = float(np.sqrt(np.einsum("ij,ij->i", a, a).max(initial=0)) * np.sqrt(np.einsum("ij,ij->i", b, b).max(initial=0)))
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
    if bound < 1 << 52:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return np.dot(whole(a), whole(b).T) if a.size and b.size else np.zeros((len(a), len(b)), object)


def _best(row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of every row; ties go to the earlier place."""
    order = np.lexsort((np.arange(len(row)), -score, row)) if score.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], i)), np.int64)
    r = row[order]
    first = np.searchsorted(r, r)
    return order[np.arange(len(r)) - first < k]


_ROWS = "leaf int, vec_id bigint, label int, q array<double>, node int, child int, low array<double>, high array<double>"


def _place(tree: Tree, dims: int):
    def run(batches):
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        schema = pa.schema([("leaf", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int32()), ("q", pa.list_(pa.float64())), ("node", pa.int32()), ("child", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        for batch in batches:
            leaf, ranges = tree.route(_matrix(batch.column(2), dims))
            for key, (low, high) in ranges.items():
                a, b = held.get(key, (low, high))
                held[key] = np.minimum(a, low), np.maximum(b, high)
            none = [pa.nulls(len(leaf), t) for t in schema.types[4:]]
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column(0), batch.column(1), batch.column(2), *none], schema=schema)
        if held:
            rows = [{"node": n, "child": c, "low": low.tolist(), "high": high.tolist()} for (n, c), (low, high) in held.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest allowed score of every row, or minus infinity."""
    s = np.where(allowed, scores.astype(np.float64), -np.inf)
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(s), -np.inf)


def _distance(tree: Tree, q: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Distance at which a row has the score; one column per column of ``score``."""
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q)[:, None] + tree.top - 2 * score, 0))


def _visits(tree: Tree, dims: int, sample: tuple[np.ndarray, np.ndarray, np.ndarray], blocks: list[list[int]], positives: int, negatives: int):
    """Anchors with a bound per window and the blocks they have to see.

    A window is (least, largest) score; the search for positives has one that is open at both ends.
    """
    ids, labels, x = sample

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                anchor, label, q = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), dims)
                scores, same = products(q, x), labels[None, :] == label[:, None]
                low, high = (_matrix(part.column(i), 5) if positives == 0 else np.empty((len(anchor), 0)) for i in (3, 4))
                if positives:
                    floor = _first(scores, same & (ids[None, :] != anchor[:, None]), positives)[:, None]
                    inner, outer = np.zeros_like(floor), np.where(np.isinf(floor), np.inf, _distance(tree, q, np.where(np.isinf(floor), 0, floor)))
                else:
                    s = scores.astype(np.float64)
                    floor = np.stack([np.maximum(low[:, p], _first(s, ~same & (s >= low[:, p : p + 1]) & (s <= high[:, p : p + 1]), negatives)) for p in range(low.shape[1])], axis=1)
                    inner, outer = _distance(tree, q, high), _distance(tree, q, floor)
                    empty = low > high
                    inner[empty], outer[empty] = np.inf, -np.inf
                seen = [[b for leaf in leaves for b in blocks[leaf]] for leaves in tree.alive(q, inner, outer)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(seen, pa.list_(pa.int32())), pa.array(list(floor), pa.list_(pa.float64()))], ["vec_id", "blocks", "floor"])

    return run


_STREAM = ["block", "copy", "kind", "vec_id", "label", "q", "floor", "high", "pids"]


def _search(dims: int, positives: int, negatives: int):
    """Per block: hold its rows (kind 0), then score the anchors that pass by (kind 1)."""
    k = positives or negatives

    def found(block, anchors):
        ids, labels, x = block
        a = np.array([r[0] for r in anchors], np.int64)
        label = np.array([r[1] for r in anchors], np.int64)
        s = products(np.array([r[2] for r in anchors]), x)
        same = labels[None, :] == label[:, None]
        floor = np.array([r[3] for r in anchors])
        if positives:
            row, col = np.nonzero(same & (ids[None, :] != a[:, None]) & (s >= floor))
            best = _best(row, s[row, col], k)
            return a[row[best]], np.zeros(len(best), np.int64), ids[col[best]], s[row[best], col[best]]
        high = np.array([r[4] for r in anchors])
        row, col = np.nonzero(~same & (s >= floor.min(axis=1, keepdims=True)) & (s <= high.max(axis=1, keepdims=True)))
        score, parts = s[row, col], []
        for p in range(floor.shape[1]):
            fits = np.flatnonzero((score >= floor[row, p]) & (score <= high[row, p]))
            best = fits[_best(row[fits], score[fits], k)]
            parts.append((a[row[best]], np.full(len(best), p), ids[col[best]], score[best]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def run(batches):
        names = ["anchor_id", "window", "id", "score"]
        here, rows, block, waiting = None, [], None, []

        def flush():
            nonlocal block, waiting
            if waiting and block is None:
                ids = np.array([r[0] for r in rows], np.int64)
                block = ids, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows]).reshape(len(rows), dims)
            if waiting and len(block[0]):
                a, p, i, s = found(block, waiting)
                # a score beyond a long is written as the nearest long
                s = np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in s], np.int64) if s.dtype == object else s.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names)
            waiting = []

        for batch in batches:
            x = _matrix(batch.column(5), dims)
            cols = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6, 7)]
            for n, (b, c, kind, i, label, floor, high) in enumerate(zip(*cols)):
                if (b, c) != here:
                    yield from flush()
                    here, rows, block = (b, c), [], None
                if kind == 0:
                    rows.append((i, label, x[n].copy()))
                    continue
                waiting.append((i, label, x[n].copy(), floor, high))
                if len(waiting) == SLICE:
                    yield from flush()
        yield from flush()

    return run


def prepared(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, q) of the rows that take part; components are ``floor(256 x)``.

    Rows without an id, label or vector, or with a component that is NULL or not finite, take no part.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    # floor() gives a long; a double that is larger than that has no fraction anyway
    scaled = F.transform(x, lambda v: F.when(F.abs(v.cast("double") * SCALE) < LONG, F.floor(F.when(F.abs(v.cast("double") * SCALE) < LONG, v.cast("double") * SCALE)).cast("double")).otherwise(v.cast("double") * SCALE))
    out = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("int").alias("label"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    return out.select("vec_id", "label", F.col("x").alias(vector)).filter(finite).select("vec_id", "label", scaled.alias("q"))


def named_once(rows: DataFrame) -> DataFrame:
    """``vec_id`` names a row: of rows that repeat an id, the one with the smallest label and vector takes part."""
    again = stored(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id"), "gnat-repeated")
    if again.isEmpty():
        return rows
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("x")).select("vec_id", "x.label", "x.q")
    return rows.join(again, "vec_id", "left_anti").select("vec_id", "label", "q").unionByName(least)


class Index:
    """All rows in the leaves of a tree that is fitted on a bounded sample."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, fanout: int = FANOUT, deepest: int = DEEPEST, leaf_rows: int = LEAF_ROWS):
        spark = rows.sparkSession
        norm = F.aggregate("q", F.lit(0.0), lambda a, v: a + v * v)
        top, dims, n = rows.agg(F.max(norm), F.max(F.size("q")), F.count(F.lit(1))).first()
        self.dims, self.n = max(dims or 0, 1), n
        levels = 1
        while levels < deepest and fanout**levels * leaf_rows < n:
            levels += 1
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # at most `sample` rows
        x = np.zeros((len(some), self.dims))
        for i, r in enumerate(some):
            x[i, : len(r.q)] = r.q
        self.sample = np.array([r.vec_id for r in some], np.int64), np.array([r.label for r in some], np.int64), x
        self.tree = fit(x, (top or 0.0) * (1 + 1e-9) + 1, levels, fanout)
        placed = stored(rows.mapInArrow(_place(self.tree, self.dims), _ROWS), "gnat-rows")
        self.rows = placed.filter("leaf IS NOT NULL").select("leaf", "vec_id", "label", "q")
        self._ranges(placed)
        # a row per leaf: at most fanout ** deepest
        sizes = {r[0]: r[1] for r in self.rows.groupBy("leaf").count().collect()}
        self.blocks, at = [], 0
        for leaf in range(self.tree.leaves):
            k = -(-sizes.get(leaf, 0) // leaf_rows)
            self.blocks.append(list(range(at, at + k)))
            at += k
        self.n_blocks = at
        table = [(leaf, b[0], len(b)) for leaf, b in enumerate(self.blocks) if b]
        self.leaves = spark.createDataFrame(table, "leaf int, first int, k int")

    def _ranges(self, placed: DataFrame) -> None:
        ends = placed.filter("node IS NOT NULL").select("node", "child", F.posexplode(F.arrays_zip("low", "high")).alias("i", "r"))
        # at most a row per node, split point and subtree: bounded by the tree's parameters
        ends = ends.groupBy("node", "child", "i").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).collect()
        for s in self.tree.split:
            self.tree.low.append(np.full((len(s), len(s)), np.inf))
            self.tree.high.append(np.full((len(s), len(s)), -np.inf))
        for r in ends:
            self.tree.low[r.node][r.i, r.child], self.tree.high[r.node][r.i, r.child] = r.low, r.high

    def search(self, anchors: DataFrame, positives: int = 0, negatives: int = 0, share: int = ANCHORS) -> DataFrame:
        """(anchor_id, window, id, score): candidates of every anchor that hold its best ones.

        ``anchors`` has vec_id, label, q, and for negatives low, high (arrays of five scores a window).
        """
        spark = anchors.sparkSession
        windows = [F.col("low"), F.col("high")] if negatives else []
        see = _visits(self.tree, self.dims, self.sample, self.blocks, positives, negatives)
        seen = anchors.select("vec_id", "label", "q", *windows).mapInArrow(see, "vec_id bigint, blocks array<int>, floor array<double>")
        seen = stored(seen, "gnat-visits")
        copies = max(1, -(-seen.count() // share))
        deal = lambda: F.pmod(F.xxhash64("vec_id"), F.lit(copies)).cast("int")
        none = F.lit(None).cast("array<double>")
        asked = anchors.join(seen.hint("merge"), "vec_id").select(
            F.explode("blocks").alias("block"), deal().alias("copy"), F.lit(1).alias("kind"), "vec_id", "label", "q", "floor", (F.col("high") if negatives else none).alias("high")
        )
        own = self.rows.join(F.broadcast(self.leaves), "leaf").select(
            (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("k"))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
            F.lit(0).alias("kind"), "vec_id", "label", "q", none.alias("floor"), none.alias("high"),
        )
        parts = max(n_tasks(spark), min(2 * self.n_blocks * copies, 20_000))
        stream = own.unionByName(asked).repartition(parts, "block", "copy").sortWithinPartitions("block", "copy", "kind", "vec_id")
        return stream.mapInArrow(_search(self.dims, positives, negatives), "anchor_id bigint, window int, id bigint, score bigint")

    def visited(self, anchors: DataFrame) -> float:
        """Share of all blocks that the search for positives sees, over all anchors."""
        see = _visits(self.tree, self.dims, self.sample, self.blocks, 5, 0)
        seen = anchors.select("vec_id", "label", "q").mapInArrow(see, "vec_id bigint, blocks array<int>, floor array<double>")
        return seen.agg(F.avg(F.size("blocks"))).first()[0] / max(self.n_blocks, 1)


def _top(found: DataFrame, k: int, *keys: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), index: Index | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` (vec_id, label, q).

    Anchors are rows whose id ``anchor_every`` divides; a score is the integer inner product with the anchor.
    An anchor's positives are its best ``positives`` other rows of the same label (at most 5), and each of them has the best
    ``negatives`` rows of other labels with ``low * positive <= 100 * score <= high * positive``. Higher scores
    come first, ties by smaller id. Vectors that are shorter than the longest count as padded with zeros. Anchors without
    positives, and positives without negatives, have no rows; an empty table gives an empty result. Scores are exact integers;
    limits of a window beyond 2^53 are rounded to a double, and a score beyond a long is written as the nearest long.
    """
    rows = named_once(rows) if index is None else rows
    index = index or Index(rows)
    anchors = index.rows.filter(F.col("vec_id") % anchor_every == 0).select("vec_id", "label", "q")
    near = _top(index.search(anchors, positives=positives), positives, "anchor_id")
    near = stored(near.select("anchor_id", "rank", "id", "score"), "gnat-positives")
    # at most `positives` entries a list
    lists = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    low, high = window
    bound = lambda v, up: F.floor(v * high / 100) if up else F.ceil(v * low / 100)
    exact = lambda p, up: bound(p["score"].cast("decimal(30,0)"), up).cast("double")
    pad = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), F.lit(5) - F.size(a)))
    lists = lists.select(F.col("anchor_id").alias("vec_id"), pad(F.transform("p", lambda p: exact(p, False)), float("inf")).alias("low"), pad(F.transform("p", lambda p: exact(p, True)), float("-inf")).alias("high"))
    asked = stored(anchors.join(lists.hint("merge"), "vec_id"), "gnat-asked")
    hard = _top(index.search(asked, negatives=negatives), negatives, "anchor_id", "window")
    named = near.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.withColumnRenamed("rank", "place").join(named.hint("merge"), ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
