"""Run registered queries beside their SQL and report differences.

    python tests/check_oracle.py /root/testdata/sf0.001 [name-part ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value: object) -> str:
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return repr(value)
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder: str, query) -> tuple[int, str]:
    frame = query.run(spark, folder)
    left = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    if query.sql is None:
        return len(left), "rows only"
    cursor = connection.execute(query.sql)
    names = [item[0] for item in cursor.description]
    right = rows_of(names, cursor.fetchall())
    if sorted(frame.columns) != sorted(names):
        return len(left), f"columns differ: {sorted(frame.columns)} / {sorted(names)}"
    if left == right:
        return len(left), "ok"
    only_left = sorted(set(left) - set(right))
    only_right = sorted(set(right) - set(left))
    return len(left), (
        f"DIFFER {len(left)} / {len(right)} rows; {sorted(names)}\n"
        f"   spark: {only_left[:4]}\n   duck:  {only_right[:4]} ({len(only_left)}/{len(only_right)})"
    )


def main() -> int:
    from tidemark.plans import CATALOG
    from tidemark.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    connection = oracle(folder)
    bad = 0
    for name, item in CATALOG.items():
        if wanted and not any(part in name for part in wanted):
            continue
        started = time.time()
        try:
            count, verdict = compare(spark, connection, folder, item)
        except Exception as error:  # report and go on to the next query
            count, verdict = -1, f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += verdict not in ("ok", "rows only")
        empty = " EMPTY" if count == 0 else ""
        print(f"{name:34s} {count:7d} rows {time.time() - started:6.1f}s  {verdict}{empty}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
