"""Run registered queries in Spark and their DuckDB oracle side by side.

usage: python scripts/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from trapline.sources.tables import TABLES, table_path  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(norm(x) for x in rec))
    return cols, out


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        print(f"{name}: spark rows={len(spdf)} ({t1 - t0:.1f}s) [no oracle]")
        return True
    dpdf = con.execute(sql).fetchdf()
    t2 = time.time()
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(dpdf)
    ok = sc == dc and len(sr) == len(dr)
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    if ok:
        ss, ds = sorted(sr, key=key), sorted(dr, key=key)
        bad = [(a, b) for a, b in zip(ss, ds) if a != b]
        ok = not bad
    print(f"{name}: {'OK' if ok else 'MISMATCH'} spark={len(sr)} duck={len(dr)} "
          f"({t1 - t0:.1f}s / {t2 - t1:.1f}s)")
    if not ok:
        if sc != dc:
            print("  cols spark:", sc)
            print("  cols duck :", dc)
        else:
            sset, dset = set(sr), set(dr)
            print("  only spark:", list(sset - dset)[:3])
            print("  only duck :", list(dset - sset)[:3])
    types_s = dict(zip(spdf.columns, [str(t) for t in spdf.dtypes]))
    types_d = dict(zip(dpdf.columns, [str(t) for t in dpdf.dtypes]))
    diff = {c: (types_s.get(c), types_d.get(c)) for c in types_s if types_s.get(c) != types_d.get(c)}
    if diff:
        print("  dtype diff:", diff)
    return ok


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from trapline.plans.catalog import ORACLES, QUERIES
    from trapline.session import get_spark
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    names = names or list(QUERIES)
    bad = []
    for n in names:
        try:
            if not compare(spark, con, n, QUERIES[n], ORACLES.get(n), sf_dir):
                bad.append(n)
        except Exception as e:  # report and continue with the next query
            print(f"{n}: ERROR {type(e).__name__}: {str(e)[:2000]}")
            bad.append(n)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
