"""Run the registered queries against their SQL twins: python -m tests.compare [sf_dir] [names...]."""

from __future__ import annotations

import datetime as dt
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, bool):
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> tuple[str, int]:
    """An empty string when both sides agree, and the number of rows."""
    got = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    relation = con.sql(sql)
    want = normal(relation.columns, relation.fetchall())
    if sorted(spark_df.columns) != sorted(relation.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(relation.columns)}", len(got)
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        return (f"{len(got)} rows vs {len(want)}; {len(extra)} only in Spark {sorted(extra)[:2]}; "
                f"{len(missing)} only in SQL {sorted(missing)[:2]}"), len(got)
    return "", len(got)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session("8"), connect(sf_dir)
    oracle, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if len(argv) > 1 and not any(a in name for a in argv[1:]):
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                problem, n = differences(df, con, oracle[name])
            else:
                problem, n = "", df.count()
                name += " (rows only)"
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {n:8d} rows {time.time() - began:6.1f}s {problem}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
