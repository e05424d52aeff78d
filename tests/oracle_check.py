"""Run registered queries next to their SQL: python tests/oracle_check.py [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    if hasattr(value, "item"):
        return _plain(value.item())
    if type(value).__name__ == "Decimal":
        return f"DECIMAL {value}"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    started = time.time()
    df = fn(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if sql is None:
        return len(got) > 0, f"rows={len(got)} (no SQL) {spent:.1f}s"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return False, f"rows {len(got)} vs {len(want)}\n   spark {extra}\n   sql   {missing}"
    if not got:
        return False, "both empty"
    return True, f"rows={len(got)} {spent:.1f}s"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from voxframe.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    # ROWS_PER_BLOCK cuts even these small tables into many blocks
    spark = local_session(**({"spark__voxframe__rowsPerBlock": os.environ["ROWS_PER_BLOCK"]} if "ROWS_PER_BLOCK" in os.environ else {}))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, note, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
