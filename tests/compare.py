"""Compare registered queries with their check SQL. Usage: python tests/compare.py SF_DIR [key ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if isinstance(v, bool) or v is None:
            return repr(v)
        if isinstance(v, float):
            return "nan" if v != v else repr(v + 0.0)
        if isinstance(v, int):
            return repr(v)
        return str(v)

    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, key, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    spark_s = time.time() - t0
    cols, got = canonical(df.columns, rows)
    if sql is None:
        return True, len(got), spark_s, 0.0, "rows only"
    t0 = time.time()
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    ocols, want = canonical(ocols, cur.fetchall())
    duck_s = time.time() - t0
    if cols != ocols:
        return False, len(got), spark_s, duck_s, f"columns {cols} != {ocols}"
    if got != want:
        extra = [g for g in got if g not in set(want)][:3]
        missing = [w for w in want if w not in set(got)][:3]
        return False, len(got), spark_s, duck_s, f"{len(got)} vs {len(want)} rows; only spark {str(extra)[:600]}; only sql {str(missing)[:600]}"
    return True, len(got), spark_s, duck_s, ""


def main() -> int:
    from firmament.registry import load
    from firmament.session import local_session

    sf, only = sys.argv[1], sys.argv[2:]
    queries, oracles = load()
    missing = [k for k in only if k not in queries]
    if missing:
        print("unknown", missing)
    spark, con = local_session(), duck(sf)
    bad = 0
    for key, fn in queries.items():
        if only and key not in only:
            continue
        try:
            ok, n, s, d, note = compare(spark, con, key, fn, oracles.get(key), sf)
        except Exception as e:  # report and go on
            ok, n, s, d, note = False, -1, 0.0, 0.0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key:28s} rows={n:<7d} spark={s:6.2f}s duck={d:6.2f}s {note}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
