"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Spark type -> the type DuckDB must give for the same column.
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, type(v).__name__, str(v)) for v in row)


def _value(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def compare(spark, con, run, sql: str, sf_dir: str) -> list[str]:
    """Differences between both results; an empty list if there are none."""
    df = run(spark, sf_dir)
    cursor = con.execute(sql)
    names, types = [d[0] for d in cursor.description], [str(d[1]) for d in cursor.description]
    theirs = cursor.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for n, t in zip(names, types):
        if TYPES.get(df.schema[n].dataType.simpleString()) != t:
            problems.append(f"type of {n}: {df.schema[n].dataType.simpleString()} != {t}")
    order = sorted(names)
    ours = [tuple(_value(r[n]) for n in order) for r in df.collect()]
    theirs = [tuple(_value(r[names.index(n)]) for n in order) for r in theirs]
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
    left, right = sorted(ours, key=_key), sorted(theirs, key=_key)
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        problems.append(f"{len(different)} of {len(left)} rows differ in {order}, e.g. {different[0]}")
    return problems


def main(sf: str, only: list[str]) -> None:
    import __spark_entry__ as entry
    from tidewash.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": os.environ.get("ZONE", "UTC"),
    })
    sf_dir = f"/root/testdata/sf{sf}"
    con, sql = connect(sf_dir), entry.oracle_sql()
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problems = compare(spark, con, run, sql[name], sf_dir) if name in sql else [f"rows only: {run(spark, sf_dir).count()}"]
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{name:28} {time.time() - start:6.2f}s", "ok" if not problems else problems, flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
