"""Compare queries with their oracle SQL: ``python tests/oracle.py sf_dir [name…]``."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from catalogue import ORACLES, QUERIES  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    """One spelling per value; numbers stay exact, whole numbers compare across types."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if value is None or isinstance(value, (bool, str)):
        return value
    return float(value) if isinstance(value, int) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def _kinds(columns, rows) -> dict[str, set]:
    return {c: {type(r[i]).__name__ for r in rows if r[i] is not None} for i, c in enumerate(columns)}


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, folder)
    collected = [tuple(r) for r in df.collect()]
    mine = rows_of(df.columns, collected)
    if name not in ORACLES:
        return False, f"no SQL; {len(mine[1])} rows"
    result = con.execute(ORACLES[name])
    names, fetched = [c[0] for c in result.description], result.fetchall()
    theirs = rows_of(names, fetched)
    if mine[0] != theirs[0]:
        return False, f"columns {mine[0]} vs {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return False, f"{len(mine[1])} vs {len(theirs[1])} rows\n  spark {sorted(a - b, key=repr)[:4]}\n  sql   {sorted(b - a, key=repr)[:4]}"
    kinds = {c: (k, _kinds(names, fetched).get(c)) for c, k in _kinds(df.columns, collected).items()}
    unlike = {c: k for c, k in kinds.items() if k[0] != k[1]}
    return True, f"{len(mine[1])} rows" + (f" types {unlike}" if unlike else "")


def main() -> int:
    from conftest import build_session

    folder, names = sys.argv[1], sys.argv[2:] or sorted(QUERIES)
    spark, con, bad = build_session(), connect(folder), 0
    for name in names:
        started = time.time()
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as failure:
            ok, note = False, f"{type(failure).__name__}: {str(failure)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    code = main()
    sys.stdout.flush()
    os._exit(1 if code else 0)
