"""Run registered queries against their SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
KINDS = {"bigint": "long", "integer": "int", "double": "double", "varchar": "string", "timestamp": "timestamp_ntz",
         "date": "date", "boolean": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a query, empty if equal."""
    rel = con.sql(sql)
    names, kinds = rel.columns, [KINDS.get(str(t).lower(), str(t).lower()) for t in rel.types]
    ours = {f.name: f.dataType.simpleString().replace("bigint", "long") for f in spark_df.schema.fields}
    problems = []
    if sorted(names) != sorted(ours):
        return [f"columns {sorted(ours)} vs {sorted(names)}"]
    for n, k in zip(names, kinds):
        if ours[n] != k:
            problems.append(f"type of {n}: {ours[n]} vs {k}")
    left = rows_of(spark_df.columns, spark_df.collect())
    right = rows_of(list(names), rel.fetchall())
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    diff = [(x, y) for x, y in zip(left, right) if x != y]
    if diff:
        problems.append(f"{len(diff)} rows differ, columns {sorted(names)}, first {diff[0]}")
    if not left:
        problems.append("no rows at all")
    return problems


def main() -> None:
    from panelspark.queries import registered
    from panelspark.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(os.environ.get("ORACLE_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, (fn, sql) in registered().items():
        if wanted and name not in wanted:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if sql:
                problems = compare(df, con, sql)
            else:
                n = len(df.collect())
                problems = [] if n else ["no rows at all"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {name} {time.time() - t0:.1f}s {problems or ''}", flush=True)
    print("failed", bad)


if __name__ == "__main__":
    main()
