"""Runs registered queries next to their SQL counterpart and compares whole results.

    python tests/oracle.py [name or prefix …]     (folder from ORACLE_SF_DIR, default sf0.01)
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return float(f"{value:.12g}") + 0.0 if math.isfinite(value) else repr(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(name, df, con, sql):
    """Empty text if equal, else what differs."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    for column, kind in df.dtypes:
        want = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}.get(kind)
        if want != kinds[column]:
            return f"type of {column}: {kind} / {kinds[column]}"
    if mine != theirs:
        a, b = [r for r in mine if r not in set(theirs)], [r for r in theirs if r not in set(mine)]
        return f"{len(mine)} / {len(theirs)} rows; {len(a)} / {len(b)} differ, e.g. {sorted(df.columns)} {a[:2]} / {b[:2]}"
    return ""


def main(names: list[str]) -> int:
    from transitus.plans import ORACLES, QUERIES
    from transitus.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(FOLDER), 0
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        started = time.time()
        try:
            df = fn(spark, FOLDER)
            if name in ORACLES:
                said = compare(name, df, con, ORACLES[name])
                count = ""
            else:
                said, count = "", f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            said, count = f"{type(error).__name__}: {str(error)[:900]}", ""
        bad += bool(said)
        print(f"{'BAD ' if said else 'ok  '} {time.time() - started:6.1f}s {name} {count} {said}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
