"""Compare registered queries with their SQL twins on the same tables.

Run as a script: ``python tests/oracle.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "item"):
        return _plain(value.item())
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(connection, sql: str):
    cursor = connection.execute(sql)
    return _rows([c[0] for c in cursor.description], cursor.fetchall())


def difference(spark_result, sql_result) -> str | None:
    (names_a, a), (names_b, b) = spark_result, sql_result
    if names_a != names_b:
        return f"columns {names_a} != {names_b}"
    if a == b:
        return None
    only_a, only_b = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
    return f"rows {len(a)} vs {len(b)}; only spark ({len(only_a)}): {only_a[:3]}; only sql ({len(only_b)}): {only_b[:3]}"


def main(argv: list[str]) -> int:
    from docweave.runtime import get_session
    import __spark_entry__ as contract
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(contract.queries())
    spark, connection = get_session("oracle", cpus=8), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            result = spark_rows(contract.queries()[name](spark, sf_dir))
            took = time.time() - start
            sql = contract.oracle_sql().get(name)
            verdict = "rows-only" if sql is None else difference(result, sql_rows(connection, sql)) or "ok"
            size = len(result[1])
        except Exception as problem:  # report and go on with the other queries
            took, size = time.time() - start, -1
            text = str(problem)
            verdict = "ERROR " + type(problem).__name__ + ": " + text[:600]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        good = verdict in ("ok", "rows-only")
        bad += not good
        print(f"{'ok ' if good else 'BAD'} {name:32s} {took:6.1f}s rows={size} {'' if verdict == 'ok' else verdict[:900]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
