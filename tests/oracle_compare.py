"""Run registered queries next to their DuckDB oracle and compare results.

    python tests/oracle_compare.py [sf_dir] [name ...]

Comparison: same column names (sorted), same row count, same multiset of
normalised rows (floats rounded to 6 places, times as ISO text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    con.execute("SET TimeZone='UTC'")
    return con


def rows_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sc, sr = rows_spark(qs[name](spark, sf_dir))
        except Exception as exc:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}"
            print(name, results[name], flush=True)
            continue
        t1 = time.time()
        if name not in oracle:
            results[name] = f"rows-only {len(sr)}"
            print(f"{name:32s} {results[name]}  spark {t1 - t0:.1f}s", flush=True)
            continue
        try:
            dc, dr = rows_duck(con, oracle[name])
        except Exception as exc:  # noqa: BLE001
            results[name] = f"DUCK ERROR {str(exc)[:300]}"
            print(name, results[name], flush=True)
            continue
        if sc != dc:
            status = f"COLUMNS {sc} vs {dc}"
        elif len(sr) != len(dr):
            status = f"ROWCOUNT {len(sr)} vs {len(dr)}"
        elif sr != dr:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b][:2]
            status = f"VALUES differ, e.g. {diff}"
        else:
            status = f"ok {len(sr)}"
        results[name] = status
        if verbose:
            print(f"{name:32s} {status[:600]}  spark {t1 - t0:.1f}s", flush=True)
    return results


if __name__ == "__main__":
    from roverlake.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]")
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if not (v.startswith("ok") or v.startswith("rows-only"))}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    sys.exit(1 if bad else 0)
