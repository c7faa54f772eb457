"""Run registered queries next to their SQL and compare schema, rows and values.

    python tools/check_oracle.py [--sf DIR] [--module NAME] [query ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tabloom.catalog import load_all  # noqa: E402
from tabloom.session import get_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(table):
    frame = table.to_pandas()
    frame = frame.reindex(sorted(frame.columns), axis=1)
    rows = [tuple(_cell(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    rows.sort(key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))
    return rows


def _cell(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        return str(v.tolist())
    return v


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    queries, oracles = load_all()
    names = args.names or [n for n, f in queries.items()
                           if not args.module or f.__module__.rsplit(".", 1)[1] in args.module.split(",")]
    spark = get_session("check", 8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = []
    for n in names:
        start = time.time()
        try:
            got = queries[n](spark, args.sf).toArrow()
            took = time.time() - start
            if n not in oracles:
                print(f"rows  {n:32s} {got.num_rows:8d} rows {took:6.2f}s", flush=True)
                continue
            want = con.execute(oracles[n]).to_arrow_table()
            problems = []
            a = {f.name: str(f.type) for f in got.schema}
            b = {f.name: str(f.type) for f in want.schema}
            if a != b:
                problems.append(f"schema {sorted(set(a.items()) ^ set(b.items()))}")
            if got.num_rows != want.num_rows:
                problems.append(f"rows {got.num_rows} vs {want.num_rows}")
            if set(a) == set(b):
                x, y = canonical(got), canonical(want)
                diff = [(p, q) for p, q in zip(x, y) if p != q]
                if diff:
                    problems.append(f"{len(diff)} rows differ, e.g. {diff[0]}")
            print(f"{'ok   ' if not problems else 'FAIL '} {n:32s} {got.num_rows:8d} rows {took:6.2f}s "
                  + "; ".join(problems)[:900], flush=True)
            if problems:
                bad.append(n)
        except Exception as e:  # report and go on
            bad.append(n)
            print(f"ERROR {n}: {type(e).__name__}: {str(e)[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(names)} run, {len(bad)} bad: {bad}")


main()
