"""Compare registered Spark plans with their SQL twins in DuckDB.

Run as a script: ``python tests/oracle.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from zonelytics.sources.adapters import BASE  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def family(dtype: str) -> str:
    d = dtype.lower()
    if d.startswith(("tinyint", "smallint", "int", "bigint", "hugeint", "long", "integer", "ubigint", "uint")):
        return "int"
    if d.startswith(("double", "float", "real")):
        return "double"
    if d.startswith("decimal"):
        return "decimal"
    if d.startswith("timestamp"):
        return "timestamp"
    if d.startswith(("string", "varchar", "char")):
        return "string"
    return d


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def norm(v):
        if v is None or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return repr(v + 0.0)
        if hasattr(v, "isoformat"):
            return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
        return str(v)
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> list[str]:
    problems = []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {n: family(str(d[1])) for n, d in zip(names, cur.description)}
    expected = canonical(cur.fetchall(), names)
    got_types = {f.name: family(f.dataType.simpleString()) for f in spark_df.schema.fields}
    if got_types != types:
        diff = {k: (got_types.get(k), types.get(k)) for k in {*got_types, *types} if got_types.get(k) != types.get(k)}
        problems.append(f"schema spark/sql {diff}")
    rows = canonical([tuple(r) for r in spark_df.collect()], spark_df.columns)
    if len(rows) != len(expected):
        problems.append(f"rows spark {len(rows)} sql {len(expected)}")
    if rows != expected:
        a, b = set(rows), set(expected)
        problems.append(f"values: {len(a - b)} differ, e.g. spark {sorted(a - b)[:2]} sql {sorted(b - a)[:2]} cols {sorted(spark_df.columns)}")
    elif not rows:
        problems.append("(empty)")
    return problems


def main(argv: list[str]) -> int:
    from zonelytics.session import local_session
    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    picked = argv[1:]
    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracle, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if picked and not any(name.startswith(p) for p in picked):
            continue
        t0 = time.time()
        try:
            if name in oracle:
                issues = compare(fn(spark, sf), con, oracle[name])
            else:
                issues = [f"(no sql, {fn(spark, sf).count()} rows)"]
        except Exception as e:  # report and go on with the next query
            issues = [f"ERROR {type(e).__name__}: {str(e)[:400]}"]
        hard = [i for i in issues if not i.startswith("(")]
        bad += bool(hard)
        print(f"{'BAD ' if hard else 'ok  '} {name} {time.time() - t0:.2f}s {'; '.join(issues)}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
