"""Run queries and their SQL side by side: ``python tests/check_oracles.py FOLDER [name ...]``."""

from __future__ import annotations

import math
import pathlib
import sys
import time
import traceback

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb

from stripgrid.catalog.oracles import ORACLES
from stripgrid.catalog.queries import QUERIES
from stripgrid.session import session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def normal(rows: list, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda c: names[c])
    return sorted((tuple(row[c] for c in order) for row in rows), key=repr)


def compare(frame, relation) -> str:
    names = frame.columns
    want = [column[0] for column in relation.description]
    if sorted(names) != sorted(want):
        return f"columns {sorted(names)} != {sorted(want)}"
    got, expected = normal(frame.collect(), names), normal(relation.fetchall(), want)
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    different = [(a, b) for a, b in zip(got, expected) if not same(a, b)]
    return f"{len(different)} of {len(got)} differ, first {different[0]}" if different else ""


def same(a: tuple, b: tuple) -> bool:
    return all(x == y and type(x) is type(y) and not negative_zero(x, y) for x, y in zip(a, b))


def negative_zero(x, y) -> bool:
    return isinstance(x, float) and x == 0 and math.copysign(1, x) != math.copysign(1, y)


def main(folder: str, names: list[str]) -> int:
    spark = session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    connection, bad = duck(folder), 0
    for name in names or list(QUERIES):
        started = time.time()
        try:
            if name in ORACLES:
                problem = compare(QUERIES[name](spark, folder), connection.execute(ORACLES[name]))
            else:
                problem = f"(no SQL) {QUERIES[name](spark, folder).count()} rows"
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:600]
        ok = not problem or problem.startswith("(no SQL)")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - started:.2f}s {problem}", flush=True)
    print(f"{bad} bad; without SQL: {sorted(set(QUERIES) - set(ORACLES))}; without query: {sorted(set(ORACLES) - set(QUERIES))}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
