"""Run registered queries on Spark and DuckDB and compare columns, types and values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, con, sf_dir, name, build, sql) -> str:
    """An empty text if both sides agree, else what differs."""
    df = build(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    types = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    wrong = {
        f.name: (f.dataType.simpleString(), types[f.name])
        for f in df.schema
        if TYPES.get(f.dataType.simpleString()) != types[f.name]
    }
    if wrong:
        return f"types {wrong}"
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"rows {len(mine)} / {len(theirs)}; only Spark {sorted(a)[:2]}; only DuckDB {sorted(b)[:2]}"
    return "" if mine else "both sides are empty"


def main(sf_dir: str, names: list[str]) -> int:
    from msgsieve.plans.oracle import oracle_sql
    from msgsieve.plans.queries import QUERIES
    from msgsieve.session import build_session

    spark, con, bad = build_session(8, "12g"), connect(sf_dir), 0
    for name, sql in oracle_sql().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, QUERIES[name], sql)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        bad += bool(problem)
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - start:.1f}s {problem[:900]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
