"""A user's function per group, fed batch by batch.

The function folds a group's Arrow batches into a small state, so a group of any size is handled in
bounded memory. With ``merge``, groups are folded where their rows lie and only states are shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

STATE_BYTES = 1 << 20


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """(key, slice, begins a group) of batches that are sorted by their first ``keys`` columns."""
    last = None
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
        at = 0
        while at < len(rows):
            end = at + 1
            while end < len(rows) and rows[end] == rows[at]:
                end += 1
            yield rows[at], batch.slice(at, end - at), last is None or rows[at] != last
            last = rows[at]
            at = end


def grouped_apply(
    df: DataFrame, by: list[str], start: Callable[[], Any], step: Callable[[Any, pa.RecordBatch], Any], finish: Callable[[Any], dict], schema: str,
    merge: Callable[[Any, Any], Any] | None = None, state_bytes: int = STATE_BYTES,
) -> DataFrame:
    """One row per group: the keys and the fields of ``finish``, named by ``schema``.

    ``step`` receives the state and the next batch of the group, without its keys, and returns the new state. A state
    that takes more than ``state_bytes`` when pickled is an error. NULL is a key like any other. Without ``merge`` all
    rows of a group pass through one task, one batch at a time; with it, rows stay where they are, each task gives one
    state per group it has, and those are merged.
    """
    fields = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)
    n, rest = len(by), [c for c in df.columns if c not in by]

    def small(state):
        data = pickle.dumps(state)
        if len(data) > state_bytes:
            raise ValueError(f"the state of a group takes {len(data)} bytes, more than {state_bytes}")
        return data

    def folded(batches, fold):
        key = state = None
        live = False
        for k, part, new in _runs(batches, n):
            if new:
                if live:
                    yield key, state
                key, state, live = k, start(), True
            state = fold(state, part.select(range(n, part.num_columns)))
        if live:
            yield key, state

    def run(fold, write):
        def task(batches):
            first = next(batches, None)
            if first is None:
                return
            keys = first.schema

            def again():
                yield first
                yield from batches

            out = []
            for k, state in folded(again(), fold):
                small(state)
                out.append({**dict(zip(by, k)), **write(state)})
                if len(out) == 1000:
                    yield from emit(out, keys)
                    out = []
            if out:
                yield from emit(out, keys)

        def emit(rows, keys):
            names = [c for c in rows[0] if c not in by]
            cols = [pa.array([r[c] for r in rows], keys.field(i).type) for i, c in enumerate(by)] + [pa.array([r[c] for r in rows]) for c in names]
            yield pa.RecordBatch.from_arrays(cols, [*by, *names])

        return task

    def done(state):
        row = finish(state)
        return {f: row[f] for f in fields}

    data = df.select(*by, *rest)
    if merge is None:
        return data.repartition(*by).sortWithinPartitions(*by).mapInArrow(run(step, done), f"{kinds}, {schema}")
    states = data.sortWithinPartitions(*by).mapInArrow(run(step, lambda state: {"state": small(state)}), f"{kinds}, state binary")

    def join_states(state, part):
        for x in part.column(0):
            state = merge(state, pickle.loads(x.as_py()))
        return state

    return states.repartition(*by).sortWithinPartitions(*by).mapInArrow(run(join_states, done), f"{kinds}, {schema}")
