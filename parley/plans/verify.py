"""Run each catalog query on Spark and its SQL twin on DuckDB; compare row count, column
names and an order-insensitive hash of the values.

    python -m parley.plans.verify [sf_dir] [name ...]
"""
from __future__ import annotations

import hashlib
import math
import os
import sys
import time


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, bool):
        return str(v)
    return str(v)


def frame_digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return [columns[i] for i in order], len(rows), h, lines


def duck(sf_dir):
    import duckdb
    from ..sources.io import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sc, sn, sh, sl = frame_digest(scols, srows)
    dc, dn, dh, dl = frame_digest(dcols, drows)
    ok = sc == dc and sn == dn and sh == dh
    detail = ""
    if not ok:
        if sc != dc:
            detail = f"cols spark={sc} duck={dc}"
        elif sn != dn:
            detail = f"rows spark={sn} duck={dn}"
        else:
            diff = sorted(set(sl) ^ set(dl))[:4]
            detail = f"values differ e.g. {diff}"
    return ok, sn, t1 - t0, detail


def main(argv):
    sys.path.insert(0, os.getcwd())
    from ..session import get_session
    from .registry import QUERIES, SQL
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")] or list(QUERIES)
    spark = get_session(master="local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        if n not in SQL:
            df = QUERIES[n](spark, sf_dir)
            print(f"ROWS  {n}: {df.count()} rows (no SQL twin)")
            continue
        try:
            ok, rows, secs, detail = compare(spark, con, n, QUERIES[n], SQL[n], sf_dir)
        except Exception as e:  # report and continue
            ok, rows, secs, detail = False, -1, 0.0, f"ERROR {type(e).__name__}: {str(e)[:300]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'}  {n}: rows={rows} {secs:.2f}s {detail}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
