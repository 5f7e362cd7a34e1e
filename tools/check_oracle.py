"""Compare registered queries with their SQL twins: python tools/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tidemill.plans.registry import all_queries, all_sql  # noqa: E402
from tidemill.plans.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        out = []
        for v in r:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                out.append("~")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                out.append(str(bool(v)))
            elif hasattr(v, "isoformat"):
                out.append(pd.Timestamp(v).isoformat())
            elif isinstance(v, (int, float)) or hasattr(v, "dtype") and getattr(v, "shape", 1) == ():
                f = float(v)
                out.append(repr(f + 0.0))
            elif hasattr(v, "__iter__") and not isinstance(v, (str, bytes)):
                out.append(str([str(x) for x in v]))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "check", master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sql = all_sql()
    bad = 0
    for name, q in all_queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            got = q(spark, sf_dir)
            types = dict(got.dtypes)
            got = got.toPandas()
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {str(e)[:600]}", flush=True)
            continue
        took = time.time() - t0
        if name not in sql:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            want = con.execute(sql[name]).fetchdf()
        except Exception as e:
            bad += 1
            print(f"SQLERR {name}: {str(e)[:600]}", flush=True)
            continue
        a, b = canon(got), canon(want)
        ok = a == b and sorted(got.columns) == sorted(want.columns)
        bad += not ok
        print(f"{'ok   ' if ok else 'DIFF '} {name}: spark {len(a)} sql {len(b)} rows {took:.1f}s", flush=True)
        if not ok:
            print("   columns", sorted(got.columns), sorted(want.columns), types)
            sa, sb = set(a), set(b)
            print("   spark only", sorted(sa - sb)[:4])
            print("   sql only  ", sorted(sb - sa)[:4])
    print("problems:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
