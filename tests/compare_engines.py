"""Run registered queries on Spark and their check SQL on DuckDB; compare as row multisets.

    python tests/compare_engines.py [--sf DIR] [name ...]

The two engines run in separate processes.
"""

from __future__ import annotations

import argparse
import os
import pickle
import subprocess
import sys
import tempfile
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    import datetime
    import decimal

    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9) + 0.0
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, datetime.datetime):
        raise TypeError("emit times as text")
    return value


def duck_side(sf: str, source: str, target: str) -> None:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    with open(source, "rb") as f:
        todo = pickle.load(f)
    out = {}
    for name, sql in todo.items():
        start = time.time()
        try:
            cur = con.execute(sql)
            cols = [d[0] for d in cur.description]
            types = [str(d[1]) for d in cur.description]
            out[name] = (cols, types, cur.fetchall(), time.time() - start)
        except Exception as err:  # reported by the caller
            out[name] = (None, None, str(err), time.time() - start)
    with open(target, "wb") as f:
        pickle.dump(out, f)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--duck", nargs=2)
    args = parser.parse_args()
    if args.duck:
        duck_side(args.sf, *args.duck)
        return 0

    import __spark_entry__ as entry
    from sablewatch.session import local_session

    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n.startswith(p) for p in args.names)]
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    source, target = f"{work}/in.pkl", f"{work}/out.pkl"
    with open(source, "wb") as f:
        pickle.dump({n: oracles[n] for n in names if n in oracles}, f)
    subprocess.run(
        [sys.executable, os.path.abspath(__file__), "--sf", args.sf, "--duck", source, target],
        check=True, timeout=1500,
    )
    with open(target, "rb") as f:
        expected = pickle.load(f)

    spark = local_session("compare", cores="8")
    bad = []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            cols, rows = df.columns, [tuple(r) for r in df.collect()]
        except Exception as err:
            print(f"FAIL {name}: spark: {str(err)[:1500]}")
            bad.append(name)
            continue
        took = time.time() - start
        if name not in expected:
            print(f"rows {name}: {len(rows)} rows {took:.1f}s (no check SQL)")
            continue
        dcols, dtypes, drows, dtook = expected[name]
        if dcols is None:
            print(f"FAIL {name}: duckdb: {drows[:1500]}")
            bad.append(name)
            continue
        if sorted(cols) != sorted(dcols):
            print(f"FAIL {name}: columns {sorted(cols)} vs {sorted(dcols)}")
            bad.append(name)
            continue
        order, dorder = sorted(range(len(cols)), key=cols.__getitem__), sorted(range(len(cols)), key=dcols.__getitem__)
        a = Counter(tuple(plain(r[i]) for i in order) for r in rows)
        b = Counter(tuple(plain(r[i]) for i in dorder) for r in drows)
        if a == b and rows:
            print(f"ok   {name}: {len(rows)} rows spark {took:.1f}s duckdb {dtook:.1f}s")
        else:
            bad.append(name)
            print(f"FAIL {name}: {len(rows)} vs {len(drows)} rows; columns {sorted(cols)}")
            for row in list((a - b).items())[:3]:
                print("   spark ", row)
            for row in list((b - a).items())[:3]:
                print("   duckdb", row)
        hints = {c: t for c, t in zip(dcols, dtypes) if t in ("HUGEINT", "INTEGER", "TIMESTAMP", "FLOAT") or "DECIMAL" in t}
        if hints:
            print(f"     {name}: duckdb types {hints} spark {[x for x in df.dtypes if x[0] in hints]}")
    print(f"{len(names) - len(bad)} of {len(names)} good; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
