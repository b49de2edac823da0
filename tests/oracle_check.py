"""Compare registered queries with their SQL on DuckDB.

Run ``python tests/oracle_check.py [name-pattern ...]`` for a subset.
"""

from __future__ import annotations

import datetime
import decimal
import os
import re
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            con.execute(
                f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')"
            )
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, bool):
        return f"bool {value}"
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir=SF_DIR):
    """Returns (problem or None, rows, spark seconds, duckdb seconds)."""
    import __spark_entry__ as entry

    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return (None if rows else "no rows"), len(rows), t1 - t0, 0.0
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    t2 = time.time()
    got_cols, got = canonical(df.columns, rows)
    want_cols, expected = canonical(names, want)
    problem = None
    if got_cols != want_cols:
        problem = f"columns {got_cols} != {want_cols}"
    elif len(got) != len(expected):
        problem = f"rows {len(got)} != {len(expected)}"
    elif got != expected:
        diff = [(g, e) for g, e in zip(got, expected) if g != e]
        problem = f"{len(diff)} rows differ, first: spark {diff[0][0]} duckdb {diff[0][1]}"
    elif not rows:
        problem = "no rows"
    return problem, len(rows), t1 - t0, t2 - t1


def main(patterns):
    from verdictframe.session import build_session

    import __spark_entry__ as entry

    spark = build_session("oracle-check")
    con = duck()
    bad = 0
    for name in entry.queries():
        if patterns and not any(re.search(p, name) for p in patterns):
            continue
        try:
            problem, n, a, b = compare(spark, con, name)
        except Exception as error:  # report and go on with the next query
            problem, n, a, b = f"{type(error).__name__}: {str(error)[:700]}", -1, 0.0, 0.0
        bad += problem is not None
        kind = "oracle" if name in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] rows={n} spark={a:.1f}s duck={b:.1f}s {problem or ''}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main(sys.argv[1:])
