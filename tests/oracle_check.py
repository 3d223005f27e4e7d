"""Run registered queries in Spark and their oracles in DuckDB and compare all rows.

    python -m tests.oracle_check [folder] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from gradelake.session import build_session


def duck(folder: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, build, sql, folder: str) -> list[str]:
    """What differs; empty when names, types of values and rows all agree."""
    result = build(spark, folder)
    mine = [tuple(row) for row in result.collect()]
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    theirs = relation.fetchall()
    problems = []
    if sorted(names) != sorted(result.columns):
        problems.append(f"columns {sorted(result.columns)} vs {sorted(names)}")
        return problems
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} vs {len(theirs)}")
    types = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
             "BOOLEAN": "boolean"}
    spark_types = dict(result.dtypes)
    for column in relation.description:
        expected = types.get(str(column[1]), str(column[1]))
        if spark_types[column[0]] != expected:
            problems.append(f"type of {column[0]}: {spark_types[column[0]]} vs {expected}")
    left, right = _rows(result.columns, mine), _rows(names, theirs)
    differing = [(a, b) for a, b in zip(left, right) if a != b]
    if differing:
        problems.append(f"{len(differing)} rows differ, first {differing[0]}")
    return problems


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        "oracle-check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    failed, oracles = 0, oracle_sql()
    for name, build in queries().items():
        if (wanted and name not in wanted) or name not in oracles:
            continue
        start = time.time()
        try:
            problems = compare(spark, connection, build, oracles[name], folder)
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s", flush=True)
        for problem in problems:
            print("     ", problem[:900])
    print("failed:", failed)


if __name__ == "__main__":
    main()
