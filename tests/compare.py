"""Compare queries with their SQL.  ``python tests/compare.py SF_DIR [query ...]``"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def compare(spark, con, name: str, sf_dir: str, build, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = build(spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(normal(r[c]) for c in columns) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return bool(rows), f"{len(rows)} rows, no SQL, {took:.1f} s"
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    fetched = cursor.fetchall()
    sql_took = time.time() - start
    if sorted(names) != columns:
        return False, f"columns {columns} against {sorted(names)}"
    place = [names.index(c) for c in columns]
    expected = [tuple(normal(r[i]) for i in place) for r in fetched]
    types = {n: str(d[1]) for n, d in zip(names, cursor.description)}
    wrong = [
        f"{c}: {t} against {types[c]}"
        for c, t in df.dtypes if TYPES.get(t, t).lower() != types[c].lower()
    ]
    a, b = Counter(rows), Counter(expected)
    if a != b:
        more, less = list((a - b).items())[:2], list((b - a).items())[:2]
        return False, f"{len(rows)} against {len(expected)} rows; only Spark {str(more)[:600]}; only SQL {str(less)[:600]}"
    note = f"{len(rows)} rows, {took:.1f} s, SQL {sql_took:.1f} s"
    return not wrong, note + (f"; TYPES {wrong}" if wrong else "")


def main() -> int:
    import __spark_entry__ as e
    from postwatch.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    if os.environ.get("SHUFFLE_PARTITIONS"):
        spark.conf.set("spark.sql.shuffle.partitions", os.environ["SHUFFLE_PARTITIONS"])
    con = connect(sf_dir)
    sqls, failed = e.oracle_sql(), []
    for name, build in e.queries().items():
        if names and name not in names:
            continue
        try:
            ok, note = compare(spark, con, name, sf_dir, build, sqls.get(name))
        except Exception as error:  # the run goes on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        if not ok:
            failed.append(name)
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(len(failed), "failed", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
