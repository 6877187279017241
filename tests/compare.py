"""Run catalogue queries and their SQL side by side: ``python tests/compare.py SF [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if both frames hold the same rows, else what differs."""
    cols = sorted(want.columns)
    if sorted(got.columns) != cols:
        return f"columns {sorted(got.columns)} != {cols}"
    kinds = [(c, got[c].dtype, want[c].dtype) for c in cols if got[c].dtype != want[c].dtype]
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    order = [c for c in cols if want[c].dtype.kind not in "f"] or cols
    a = got[cols].sort_values(order + [c for c in cols if c not in order]).reset_index(drop=True)
    b = want[cols].sort_values(order + [c for c in cols if c not in order]).reset_index(drop=True)
    for c in cols:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = np.flatnonzero(~same)[0]
            return f"{c}: {int((~same).sum())} differ, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return f"(types {kinds})" if kinds else None


def main() -> None:
    import __spark_entry__ as entry
    from stormgrid.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = local_session("8"), duck(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
        except Exception as e:  # report and go on with the next query
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        t1 = time.time()
        sql = entry.oracle_sql().get(name)
        if sql is None:
            print(f"rows {name}: {len(got)} ({t1 - t0:.1f}s)", flush=True)
            continue
        try:
            want = con.execute(sql).df()
        except Exception as e:
            print(f"SQL  {name}: {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        diff = difference(got, want)
        bad += diff is not None and not diff.startswith("(")
        print(f"{'ok  ' if diff is None else 'DIFF'} {name}: {len(got)} rows, spark {t1 - t0:.1f}s, sql {time.time() - t1:.1f}s {diff or ''}", flush=True)
    print(f"{bad} bad", flush=True)


if __name__ == "__main__":
    main()
