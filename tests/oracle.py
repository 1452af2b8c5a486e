"""Compare registered queries with their SQL on DuckDB: `python -m tests.oracle [sf_dir] [name …]`."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(df, con, sql: str) -> str | None:
    """None when names, types and rows agree, else what differs."""
    names = sorted(df.columns)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    theirs = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(theirs) != names:
        return f"columns {names} != {sorted(theirs)}"
    at = [theirs.index(n) for n in names]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    if got != want:
        diff = next(((g, w) for g, w in zip(got, want) if g != w), None)
        return f"rows {len(got)} vs {len(want)}; first difference {diff}"
    odd = {n: (t, kinds[n]) for n, t in df.dtypes if _KINDS.get(t) != kinds[n]}
    return f"types {odd}" if odd else None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from wardflow.session import session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = argv[1:]
    spark = session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    sqls = entry.oracle_sql()
    for name, run in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        started = time.perf_counter()
        try:
            df = run(spark, sf_dir)
            problem = compare(df, con, sqls[name]) if name in sqls else f"(no oracle, {len(df.collect())} rows)"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        seconds = time.perf_counter() - started
        failed = problem is not None and not problem.startswith("(no oracle")
        bad += failed
        print(f"{'FAIL' if failed else 'ok'} {name} {seconds:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
