"""Run registered queries next to their SQL twins and compare the rows.

    python -m tests.compare [sf_dir] [name ...]
"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, db, build, sql, sf_dir):
    df = build(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    return got, want


def main():
    from __spark_entry__ import oracle_sql, queries
    from marquee.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, db, oracles = local_session(), connect(sf_dir), oracle_sql()
    for name, build in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name not in oracles:
                print(f"{name}: rows only, {build(spark, sf_dir).count()} rows, {time.time() - start:.1f}s", flush=True)
                continue
            (gc, got), (wc, want) = compare(spark, db, build, oracles[name], sf_dir)
            same = gc == wc and got == want
            print(f"{name}: {'ok' if same else 'DIFFERS'}, {sum(got.values())} rows, {time.time() - start:.1f}s", flush=True)
            if not same:
                print("   columns", gc, wc)
                print("   rows", sum(got.values()), sum(want.values()))
                print("   only here ", list((got - want).items())[:3])
                print("   only there", list((want - got).items())[:3])
        except Exception as error:  # noqa: BLE001
            print(f"{name}: FAILED {str(error)[:600]}", flush=True)


if __name__ == "__main__":
    main()
