"""Compare registered queries with their SQL: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object).where(lambda f: f.notna(), None)
    keys = [tuple("" if v is None else str(v) for v in row) for row in frame.itertuples(index=False)]
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    return frame.iloc[order].reset_index(drop=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when both frames hold the same rows exactly, else what differs."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for c in left.columns:
        # A long column with nulls comes as floats from one engine and as nullable integers from the other.
        if {str(left[c].dtype), str(right[c].dtype)} == {"float64", "Int64"} and left[c].isna().any():
            continue
        if left[c].dtype != right[c].dtype and not {left[c].dtype.kind, right[c].dtype.kind} <= {"O", "U", "T"} and str(right[c].dtype) != "str" and str(left[c].dtype) != "str":
            return f"type of {c}: {left[c].dtype} != {right[c].dtype}"
    a, b = _sorted(left), _sorted(right)
    for c in a.columns:
        bad = [i for i, (x, y) in enumerate(zip(a[c], b[c])) if not (x == y or (x is None and y is None))]
        if bad:
            gaps = [abs(float(a[c][i]) - float(b[c][i])) for i in bad if isinstance(a[c][i], (float, np.floating)) and isinstance(b[c][i], (float, np.floating))]
            return f"{len(bad)} values of {c} differ (largest gap {max(gaps) if gaps else '-'}), first: {a.iloc[bad[0]].to_dict()} != {b.iloc[bad[0]].to_dict()}"
    return None


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    from gaugelab.storage import local_session

    spark = local_session("oracle-check", "8")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args[1:] or queries:
        try:
            t0 = time.time()
            got = queries[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"rows {name}: {len(got)} rows {t1 - t0:.2f}s", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            t2 = time.time()
            problem = difference(got, want)
        except Exception as error:  # report and go on
            problem, t2 = f"{type(error).__name__}: {str(error)[:1500]}", time.time()
            t1 = t2
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} spark {t1 - t0:.2f}s sql {t2 - t1:.2f}s {len(got) if not problem else ''} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
