"""Run registered queries against their SQL twins: check_queries.py [sf] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from headwise.plans import catalog  # noqa: E402
from headwise.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def rows_of(records, columns):
    order = sorted(columns)
    index = [columns.index(c) for c in order]
    return sorted(tuple(normal(r[i]) for i in index) for r in records), order


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    base = f"/root/testdata/sf{sf}"
    names = sys.argv[2:]
    spark = build_session(
        "check",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    bad = 0
    for name, q in catalog.load_all().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        started = time.time()
        try:
            df = q.run(spark, base)
            got, cols = rows_of(df.collect(), df.columns)
            took = time.time() - started
            if q.sql is None:
                print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            cur = db.execute(q.sql)
            want_cols = [d[0] for d in cur.description]
            want, wcols = rows_of(cur.fetchall(), want_cols)
            if cols != wcols:
                print(f"BAD  {name}: columns {cols} != {wcols}")
                bad += 1
            elif got != want:
                bad += 1
                only = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
                print(f"BAD  {name}: {len(got)} vs {len(want)} rows; {cols}\n   spark {only[0]}\n   sql   {only[1]}")
            else:
                print(f"ok   {name}: {len(got)} rows {took:.1f}s", flush=True)
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
    print("bad:", bad)


main()
