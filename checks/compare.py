"""Run queries in Spark and their SQL in the checking engine and compare the rows.

    python -m checks.compare FOLDER [NAME ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracle import ORACLE
from rolesift.catalog import QUERIES
from rolesift.session import local_session
from rolesift.sources.views import GIVEN


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in GIVEN:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, folder)
    mine = _rows(df.columns, df.collect())
    spent = time.time() - start
    if name not in ORACLE:
        return True, f"{len(mine)} rows, no SQL, {spent:.2f}s"
    start = time.time()
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    theirs = _rows(columns, result.fetchall())
    times = f"{spent:.2f}s / {time.time() - start:.2f}s"
    if sorted(columns) != sorted(df.columns):
        return False, f"columns differ: {sorted(set(columns) ^ set(df.columns))}"
    if mine != theirs:
        extra = sorted(set(mine) - set(theirs))[:2]
        missing = sorted(set(theirs) - set(mine))[:2]
        return False, (
            f"{len(mine)} rows vs {len(theirs)}\n   columns {sorted(columns)}"
            f"\n   spark {extra}\n   sql   {missing}"
        )
    return True, f"{len(mine)} rows, {times}"


def main(folder: str, names: list[str]) -> int:
    spark, con, bad = local_session(8), connect(folder), 0
    for name in names or QUERIES:
        try:
            ok, text = compare(spark, con, folder, name)
        except Exception as problem:
            ok, text = False, f"{type(problem).__name__}: {problem}"[:900]
        bad += not ok
        print("ok  " if ok else "BAD ", f"{name:30s}", text, flush=True)
    print(f"{bad} of {len(names or QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
