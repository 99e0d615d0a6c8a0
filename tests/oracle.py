"""Compare registered queries with their oracle SQL in DuckDB.

Command line: ``python tests/oracle.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from querywarden.plans.inputs import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def canon(value) -> str:
    if value is None:
        return "~null~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


DUCK_TO_SPARK = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if got != want:
        only_got = sorted(set(got) - set(want))[:3]
        only_want = sorted(set(want) - set(got))[:3]
        return f"rows {len(got)} vs {len(want)}\n   spark only: {only_got}\n   oracle only: {only_want}"
    for name, typ in df.dtypes:
        want_type = DUCK_TO_SPARK.get(types[name], types[name])
        if typ != want_type and not (typ in ("int", "bigint") and want_type in ("int", "bigint")):
            return f"type of {name}: {typ} vs {types[name]}"
    return None if got else "no rows"


def main(argv: list[str]) -> int:
    from querywarden.plans.catalog import ORACLES, QUERIES
    from querywarden.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if argv[1:] and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv[1:]):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, sf_dir, fn, ORACLES[name])
                note = "ok" if problem is None else problem
            else:
                problem, note = None, f"rows {fn(spark, sf_dir).count()} (no oracle)"
        except Exception as exc:  # report and go on
            problem = note = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'PASS'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
