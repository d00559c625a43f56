"""Compare registered queries with their SQL on DuckDB: python tests/check_oracles.py SF_DIR [name part ...]."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value + 0.0) if value else "0.0"
    return None if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(canonical(row[i]) for i in order) for row in rows), key=lambda t: tuple("" if v is None else v for v in t))


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    odd = [(d[0], str(d[1])) for d in cur.description if "DECIMAL" in str(d[1]) or "HUGEINT" in str(d[1]) or "[]" in str(d[1])]
    if odd:
        return f"oracle types {odd}"
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:3]}" if bad else None


def main() -> int:
    from siftwell.plans import catalog
    from siftwell.session import local_session

    sf, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session("8", spark__ui__showConsoleProgress="false"), connect(sf)
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = None if len(df.collect()) else "no rows"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
