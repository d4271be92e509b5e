"""Compare registered queries with their SQL in DuckDB: ``python tests/compare.py <sf dir> [query ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows: list[tuple]) -> list[tuple]:
    def cell(v):
        if v is None:
            return (0, "")
        if isinstance(v, float):
            return (1, "nan" if math.isnan(v) else repr(round(v, 6) + 0.0))
        return (2, str(v))

    return sorted(tuple(cell(v) for v in r) for r in rows)


def check(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both results agree, else what differs."""
    cols = sorted(spark_df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    got_table = spark_df.select(*[f"`{c}`" for c in cols]).toArrow()
    want = con.execute(f"SELECT {quoted} FROM ({sql})")
    want_names = sorted(d[0] for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description)
    want = con.execute(f"SELECT {quoted} FROM ({sql})").to_arrow_table() if want_names == cols else None
    if want is None:
        return f"columns {cols} / {want_names}"
    got = canonical(list(zip(*[c.to_pylist() for c in got_table.columns])) if got_table.num_rows else [])
    exp = canonical(list(zip(*[c.to_pylist() for c in want.columns])) if want.num_rows else [])
    types = [f"{c}: {a} / {b}" for c, a, b in zip(cols, got_table.schema.types, want.schema.types) if str(a) != str(b)]
    if got != exp:
        a, b = set(got), set(exp)
        return f"rows {len(got)} / {len(exp)}\n   spark only {sorted(a - b)[:2]}\n   sql only   {sorted(b - a)[:2]} {types}"
    return f"types {types}" if types else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from corpusloom.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            result = check(df, con, oracles[name]) if name in oracles else f"no SQL, {df.count()} rows"
        except Exception as e:  # report and go on
            result = "ERROR " + str(e)[:500]
        print(f"{name:28s} {time.time() - started:5.1f}s {result or 'ok'}", flush=True)
