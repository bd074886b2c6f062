"""Runs registered queries in both engines and compares rows: python tests/compare.py [sf] [name...]"""

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def oracle_rows(sf_dir, sql):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    result = db.execute(sql)
    return rows_of([d[0] for d in result.description], result.fetchall())


def compare(spark, sf_dir, name):
    """None when equal, else a short account of the difference."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    got, columns = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None
    want, wanted = oracle_rows(sf_dir, sql)
    if columns != wanted:
        return f"columns {columns} != {wanted}"
    if got == want:
        return None if got else "no rows"
    extra = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else []
    lost = [r for r in want if r not in set(got)][:2] if len(got) < 50000 else []
    return f"{len(got)} rows against {len(want)}; only here {extra}; only there {lost}"


def main():
    from tests.conftest import make_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = make_session()
    for name in names:
        start = time.time()
        try:
            fault = compare(spark, f"/root/testdata/{sf}", name)
        except Exception as error:  # shown, and the next query is tried
            fault = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if fault is None else 'FAIL'} {name} {time.time() - start:.1f}s {(fault or '')[:2500]}", flush=True)


if __name__ == "__main__":
    main()
