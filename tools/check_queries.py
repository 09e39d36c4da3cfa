"""Run registered queries and their SQL on the same parquet tables and compare the rows.

Usage: python tools/check_queries.py SF_DIR [module-or-query ...]
"""

from __future__ import annotations

import glob
import importlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from annoframe.plans import base  # noqa: E402
from annoframe.session import local_session  # noqa: E402


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9)
    if hasattr(v, "as_tuple"):
        return round(float(v), 9)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main() -> int:
    sf, wanted = sys.argv[1], sys.argv[2:]
    mods = [w for w in wanted if os.path.exists(f"annoframe/plans/{w}.py")]
    names = [w for w in wanted if w not in mods]
    if mods:
        for m in mods:
            importlib.import_module(f"annoframe.plans.{m}")
    else:
        importlib.import_module("annoframe.plans")
    chosen = [
        q for q in base.QUERIES
        if (not names and (not mods or base.QUERIES[q].__module__.rsplit(".", 1)[-1] in mods)) or q in names
    ]
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name in chosen:
        t0 = time.time()
        try:
            df = base.QUERIES[name](spark, sf)
            got = rows_of(df.columns, df.collect())
            t1 = time.time()
            if name not in base.SQL:
                print(f"{name:32s} rows-only {len(got):7d} rows  {t1 - t0:6.1f}s", flush=True)
                continue
            cur = con.execute(base.SQL[name])
            cols = [d[0] for d in cur.description]
            exp = rows_of(cols, cur.fetchall())
            t2 = time.time()
            state = "ok"
            if sorted(cols) != sorted(df.columns):
                state = f"COLUMNS {sorted(set(cols) ^ set(df.columns))}"
            elif got != exp:
                diff = [(g, e) for g, e in zip(got, exp) if g != e][:2]
                state = f"ROWS {len(got)} vs {len(exp)} first {diff}"
            bad += state != "ok"
            print(f"{name:32s} {state[:900]} {len(got):7d} rows  {t1 - t0:6.1f}s sql {t2 - t1:5.1f}s", flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"{name:32s} ERROR {str(exc)[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
