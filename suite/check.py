"""Run queries next to their SQL in DuckDB and compare: ``python -m suite.check [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if isinstance(v, (int, datetime.datetime)):
        return v
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(row[i]) for i in order) for row in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SAME_TYPE = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
    "array<double>": {"DOUBLE[]"}, "array<bigint>": {"BIGINT[]"}, "array<string>": {"VARCHAR[]"},
}


def compare(spark, con, sf_dir: str, q) -> tuple[str, int]:
    """('ok' | 'rows' | reason, row count)."""
    df = q.run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if q.sql is None:
        return "rows", len(got)
    con.execute(q.sql)
    names = [d[0] for d in con.description]
    types = {d[0]: str(d[1]) for d in con.description}
    want = rows_of(names, con.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    for f in df.schema.fields:
        if types[f.name] not in SAME_TYPE.get(f.dataType.simpleString(), {f.dataType.simpleString()}):
            return f"type of {f.name}: {f.dataType.simpleString()} != {types[f.name]}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {sorted(df.columns)}: {bad[0][0]} != {bad[0][1]}", len(got)
    return "ok", len(got)


def main() -> int:
    from axonframe.session import get_spark
    from suite import load_all

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and Path(args[0]).is_dir() else "/root/testdata/sf0.01"
    spark = get_spark(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name, q in load_all().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            verdict, n = compare(spark, con, sf_dir, q)
        except Exception as e:  # report and go on with the next query
            verdict, n = f"{type(e).__name__}: {str(e).strip()[:700]}", -1
        bad = verdict not in ("ok", "rows")
        failed += bad
        print(f"{'FAIL' if bad else '    '} {name:34s} {n:8d} rows {time.time() - t0:6.2f}s  {verdict}", flush=True)
    print(f"{failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
