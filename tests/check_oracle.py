"""Run registered queries beside their SQL and report mismatches.

    python tests/check_oracle.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(
            lambda v: "~" if v is None or (isinstance(v, float) and v != v)
            else f"{float(v):.5f}" if isinstance(v, float) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got), canonical(want)
    differ = (a != b).any(axis=1)
    if differ.any():
        return f"{int(differ.sum())} rows differ, first\n{a[differ].head(3)}\n{b[differ].head(3)}"
    return ""


def main():
    import __spark_entry__ as entry
    from rememora.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(entry.queries())
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            got = entry.queries()[name](spark, folder).toPandas()
        except Exception as exc:  # report and go on with the next query
            print(f"FAIL {name}: {str(exc)[:1500]}", flush=True)
            bad += 1
            continue
        t1 = time.time()
        sql = entry.oracle_sql().get(name)
        if sql is None:
            print(f"rows {name}: {len(got)} rows, {t1 - t0:.1f}s, no SQL", flush=True)
            continue
        try:
            problem = compare(got, con.execute(sql).df())
        except Exception as exc:
            problem = f"SQL {str(exc)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name}: {len(got)} rows, spark {t1 - t0:.1f}s, "
              f"sql {time.time() - t1:.1f}s {problem}", flush=True)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
