"""Compare registered queries with their oracles: python tests/check_oracle.py [sf_dir] [name part ...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from contract.views import DRIVER_TABLES  # noqa: E402


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("runlore")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connection(sf_dir: str):
    con = duckdb.connect()
    for table in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def value(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6f}"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def difference(spark, con, build, sql: str, sf_dir: str) -> str | None:
    """None when both engines give the same rows, else what differs first."""
    df = build(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(value(r[n]) for n in names) for r in df.collect())
    relation = con.sql(sql)
    if sorted(relation.columns) != names:
        return f"columns {names} / {sorted(relation.columns)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    odd = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t) != types[c]]
    at = [relation.columns.index(n) for n in names]
    theirs = sorted(tuple(value(r[i]) for i in at) for r in relation.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return "\n".join(f"{n}: {x} / {y}" for n, x, y in zip(names, a, b) if x != y) + f"\n in {a}"
    if odd:
        return f"types {odd}"
    return None if ours else "no rows"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = session(), connection(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, build in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        began = time.time()
        try:
            if name in sqls:
                wrong = difference(spark, con, build, sqls[name], sf_dir)
                state = "ok" if wrong is None else f"DIFFERS\n{wrong}"
            else:
                wrong, state = None, f"{len(build(spark, sf_dir).collect())} rows, no oracle"
        except Exception as error:  # noqa: BLE001
            wrong = state = f"ERROR {str(error)[:1500]}"
        bad += wrong is not None
        print(f"{name}: {state} ({time.time() - began:.1f}s)", flush=True)
    print(f"{bad} of the checked queries differ")


if __name__ == "__main__":
    main()
