"""Run queries and their SQL side by side: python -m checks.compare SF_DIR [NAME...]"""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

from checks.oracles import oracle_sql
from checks.queries import queries


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(file)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def spark_result(df: DataFrame):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, text: str):
    cursor = con.execute(text)
    columns = [d[0] for d in cursor.description]
    return _rows(columns, cursor.fetchall())


def difference(df: DataFrame, con, text: str) -> str | None:
    """None if both hold the same rows, else what differs first."""
    (sc, sr), (dc, dr) = spark_result(df), duck_result(con, text)
    if sc != dc:
        return f"columns {sc} against {dc}"
    if not sr:
        return "no rows"
    if len(sr) != len(dr):
        only = [r for r in sr if r not in set(dr)][:2], [r for r in dr if r not in set(sr)][:2]
        return f"{len(sr)} rows against {len(dr)}: {only}"
    for a, b in zip(sr, dr):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sum(x != y for x, y in zip(sr, dr))} of {len(sr)} rows, {sc}: {a} against {b}"
    return None


def main(argv: list[str]) -> int:
    from repeatwise.session import local_session

    sf, names = argv[0], argv[1:]
    spark, con = local_session(), connect(sf)
    oracle, bad = oracle_sql(), 0
    for name, q in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            result = difference(q(spark, sf), con, oracle[name])
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            result = f"{type(e).__name__}: {str(e).splitlines()[0][:600]}"
        bad += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.1f}s "
              f"{result or ''}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
