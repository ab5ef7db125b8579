"""Local twin of the driver's correctness gate: Spark query vs DuckDB SQL.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, column names and an order-insensitive value hash.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from flowlens.functions.exprs import round_doubles  # noqa: E402
from flowlens.plans.registry import load_all  # noqa: E402
from flowlens.plans import registry  # noqa: E402
from flowlens.session import get_session  # noqa: E402
from flowlens.sources.tables import TABLES, table_path  # noqa: E402


ROUNDED: dict = {}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (list, dict)):
        try:
            return norm(v.item())
        except Exception:
            pass
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return int(v)
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.md5("\n".join(keyed).encode()).hexdigest(), keyed


def main():
    args = sys.argv[1:]
    twins_only = "--twins-only" in args
    args = [a for a in args if a != "--twins-only"]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    load_all()
    global ROUNDED
    ROUNDED = registry.rounded_oracle()
    spark = get_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    bad = 0
    for name, fn in registry.QUERIES.items():
        if names and name not in names:
            continue
        if twins_only and name not in registry.ORACLE:
            continue
        t0 = time.time()
        try:
            sdf = round_doubles(fn(spark, sf_dir))
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = ROUNDED.get(name)
        if sql is None:
            print(f"{name:28s} rows-only  spark={len(srows)} ({ts:.1f}s)")
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} DUCK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        hs, ks = digest(scols, srows)
        hd, kd = digest(dcols, drows)
        ok = len(srows) == len(drows) and sorted(scols) == sorted(dcols) and hs == hd
        if not ok:
            bad += 1
            print(f"{name:28s} MISMATCH rows {len(srows)}/{len(drows)} cols {sorted(scols) == sorted(dcols)} "
                  f"hash {hs == hd}")
            if sorted(scols) != sorted(dcols):
                print("   spark:", sorted(scols), "\n   duck: ", sorted(dcols))
            else:
                diff_s = [k for k in ks if k not in set(kd)][:3]
                diff_d = [k for k in kd if k not in set(ks)][:3]
                print("   spark-only:", diff_s, "\n   duck-only: ", diff_d)
        else:
            print(f"{name:28s} ok rows={len(srows)} ({ts:.1f}s)")
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
