"""Compare registered queries with their SQL twins in DuckDB.

Run as a script: ``python tests/oracle.py <folder> [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


TIMES: dict[str, float] = {}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(value):
    if value is None:
        return "~null"
    if isinstance(value, float):
        if math.isnan(value):
            return "~nan"
        return repr(value + 0.0)
    return repr(value)


def compare(spark, con, func, sql: str, folder: str) -> str | None:
    """None if equal, else what differs."""
    df = func(spark, folder)
    got_types = dict(df.dtypes)
    start = time.time()
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want_types = dict(zip(names, [str(x[1]) for x in cur.description]))
    if sorted(got_types) != sorted(names):
        return f"columns {sorted(got_types)} vs {sorted(names)}"
    for c, t in got_types.items():
        if SAME_TYPE.get(t, t) != want_types[c]:
            return f"type of {c}: {t} vs {want_types[c]}"
    order = sorted(names)
    place = [names.index(c) for c in order]
    want = sorted(tuple(_key(r[i]) for i in place) for r in cur.fetchall())
    TIMES["sql"] = time.time() - start
    got = sorted(tuple(_key(v) for v in r) for r in df.select(*[f"`{c}`" for c in order]).collect())
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; only spark {[x for x in got if x not in set(want)][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {order}: {bad[0][0]} vs {bad[0][1]}"
    if not got:
        return "no rows"
    return None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from cytoplane.session import get_spark

    folder, names = sys.argv[1], sys.argv[2:]
    spark = get_spark("oracle", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls, funcs = oracle_sql(), queries()
    failed = 0
    for name in names or list(funcs):
        start = time.time()
        TIMES.clear()
        try:
            if name in sqls:
                problem = compare(spark, con, funcs[name], sqls[name], folder)
                kind = "sql"
            else:
                n = len(funcs[name](spark, folder).collect())
                problem, kind = (None if n else "no rows"), f"rows={n}"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
            kind = "error"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s (sql {TIMES.get('sql', 0):.1f}s) {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
