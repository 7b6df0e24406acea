"""Run queries and their SQL side by side and report where they differ.

    python tests/oracle.py [sf folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value) if not isinstance(value, str) else value


def _rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(frame, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    started = time.time()
    got = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    print(f"[{len(got[1])} rows, {time.time() - started:.1f}s in the last job]", end=" ")
    cursor = con.execute(sql)
    want = _rows([column[0] for column in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        only_got = sorted(set(got[1]) - set(want[1]))[:3]
        only_want = sorted(set(want[1]) - set(got[1]))[:3]
        return f"{len(got[1])} rows != {len(want[1])} rows; only here {only_got}; only there {only_want}"[:1500]
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from corpuslab.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = build_session(
        "oracle",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        started = time.time()
        try:
            frame = queries()[name](spark, folder)
            sql = oracle_sql().get(name)
            if sql is None:
                result = f"rows only: {frame.count()}"
            else:
                result = difference(frame, con, sql) or "same"
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += result != "same"
        print(f"{name}: {result} ({time.time() - started:.1f}s)", flush=True)
    print(f"{failed} of {len(names)} not the same")


if __name__ == "__main__":
    main()
