"""Compare registered queries with their DuckDB statements.

Run as ``python tests/oracle_check.py SF_DIR [name ...]``.
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, name: str, build, sql: str | None) -> str:
    """Empty text when equal, else what differs."""
    frame = build(spark, sf_dir)
    names, rows = frame.columns, [tuple(r) for r in frame.collect()]
    if sql is None:
        return "" if rows else "no rows"
    result = connection.execute(sql)
    expected_names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(expected_names):
        return f"columns {sorted(names)} against {sorted(expected_names)}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows against {len(expected)}"
    got, wanted = _sorted_rows(names, rows), _sorted_rows(expected_names, expected)
    differing = [(a, b) for a, b in zip(got, wanted, strict=True) if a != b]
    if differing:
        return f"{len(differing)} of {len(rows)} rows differ, first {str(differing[0])[:600]}"
    return "" if rows else "EMPTY on both sides"


def main() -> None:
    from conftest import test_session

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, connection, oracles = test_session(), connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name, build, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += bool(problem)
        mark = problem or ("ok" if name in oracles else "ok (rows only)")
        print(f"{name:32s} {time.time() - start:6.2f}s  {mark}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
