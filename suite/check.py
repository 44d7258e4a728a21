"""Compare every query with its SQL twin: ``python -m suite.check [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from inkgrid.session import build_session
from suite.oracle import ORACLE
from suite.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = pd.DataFrame(index=df.index)
    for name in df.columns:
        col = df[name]
        out[name] = [None if v is None or v is pd.NA or v != v else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in col.tolist()]
    out = out.astype(object).where(out.notna(), None)
    keys = out.apply(lambda r: "\x1f".join(map(str, r)), axis=1) if len(out) else pd.Series(dtype=str)
    return keys.sort_values(ignore_index=True)


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session(
        "inkgrid-check", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
        spark__driver__memory="10g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            got_df = QUERIES[name](spark, sf_dir)
            got = got_df.toPandas()
            spent = time.time() - start
            if name not in ORACLE:
                print(f"{name:28s} rows-only {len(got)} {spent:.1f}s", flush=True)
                continue
            want = con.execute(ORACLE[name]).df()
            if sorted(got.columns) != sorted(want.columns):
                bad += 1
                print(f"{name:28s} COLUMNS {sorted(got.columns)} != {sorted(want.columns)}", flush=True)
                continue
            kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
            a, b = _plain(got), _plain(want)
            same = len(a) == len(b) and (a == b).all()
            print(f"{name:28s} {'ok' if same else 'DIFF'} {len(a)}/{len(b)} {spent:.1f}s {kinds or ''}", flush=True)
            if not same:
                bad += 1
                left, right = set(a), set(b)
                print("   columns", sorted(got.columns))
                for label, rows in (("spark", sorted(left - right)[:3]), ("sql", sorted(right - left)[:3])):
                    for row in rows:
                        print("  ", label, row.replace("\x1f", " ¦ ")[:600])
        except Exception as exc:  # report and go on with the next query
            bad += 1
            print(f"{name:28s} ERROR {type(exc).__name__}: {str(exc)[:700]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
