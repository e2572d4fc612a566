"""Compare registered queries with their SQL on DuckDB: python check.py [sf_dir] [name ...]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

from rxloom.plans.registry import load_all
from rxloom.session import build_session, stored_tables, use_local_folder


def canonical(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if value != value else (int(value) if value == int(value) and abs(value) < 1e15 else round(value, 6))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    use_local_folder(spark)
    bad = []
    for name, q in load_all().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            t0 = time.time()
            with stored_tables(spark):
                df = q.run(spark, sf)
                got = rows_of(df.columns, df.collect())
            t1 = time.time()
            if q.oracle is None:
                print(f"rows  {name}: {len(got)} rows {t1 - t0:.1f}s")
                continue
            cur = con.execute(q.oracle)
            cols = [c[0] for c in cur.description]
            want = rows_of(cols, cur.fetchall())
            t2 = time.time()
            ok = sorted(cols) == sorted(df.columns) and got == want
            print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(got)}/{len(want)} rows spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   cols", sorted(df.columns), sorted(cols))
                gs, ws = set(map(repr, got)), set(map(repr, want))
                for r in sorted(gs - ws)[:3]:
                    print("   spark ", r[:300])
                for r in sorted(ws - gs)[:3]:
                    print("   duckdb", r[:300])
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
