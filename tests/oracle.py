"""Runs a query on Spark and its SQL on DuckDB and compares rows, names and types."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def rows_of(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    made = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(made, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    types = {d[0]: str(d[1]) for d in want.description}
    want_rows = want.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    for field in df.schema:
        kind = field.dataType.simpleString()
        if KINDS.get(kind) != types[field.name]:
            return f"type of {field.name}: {kind} vs {types[field.name]}"
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    expected = rows_of(want_rows, names)
    if len(got) != len(expected):
        return f"{len(got)} rows vs {len(expected)}"
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0][0]} vs {bad[0][1]}"
    return None if got else "empty result"


def main(names: list[str], sf: str) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from vocalgrid.plans import catalog
    from vocalgrid.session import local_session

    catalog.load_all()
    spark = local_session(8)
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    wrong = 0
    for name in names or list(catalog.QUERIES):
        start = time.time()
        try:
            if name in catalog.ORACLES:
                found = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], sf_dir)
            else:
                n = catalog.QUERIES[name](spark, sf_dir).count()
                found = None if n else "empty result"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        wrong += found is not None
        note = "" if name in catalog.ORACLES else " (rows only)"
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.2f}s{note} {found or ''}", flush=True)
    print(f"{wrong} wrong")
    return wrong


if __name__ == "__main__":
    args = sys.argv[1:]
    scale = args.pop(0) if args and args[0].startswith("0.") else "0.01"
    sys.exit(main(args, scale))
