"""Run registered queries against their SQL on the given tables: python -m tests.compare [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    names, rows = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    sql_names, sql_rows = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != sql_names:
        return f"columns {names} / {sql_names}"
    if not rows:
        return "no rows"
    if rows != sql_rows:
        only, sql_only = sorted(set(rows) - set(sql_rows)), sorted(set(sql_rows) - set(rows))
        return f"rows {len(rows)} / {len(sql_rows)}, {len(only)} differ\n   spark {only[:2]}\n   sql   {sql_only[:2]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from changelens.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark, con = local_session(), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            result = difference(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += result is not None and not result.startswith("rows only")
        print(f"{name:32s} {time.time() - start:6.1f}s  {'ok' if result is None else result}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
