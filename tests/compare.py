"""Run registered queries beside their checking SQL and compare the results exactly."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessaly.session import TABLES, build_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0 if value else 0.0)
    if isinstance(value, bool):
        return f"bool:{value}"
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


def difference(spark, connection, sf_dir, name, build, sql):
    """None when equal, else a short description."""
    frame = build(spark, sf_dir)
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None if mine else "no rows"
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}"
    if not mine:
        return "no rows"
    if mine != theirs:
        left, right = mine - theirs, theirs - mine
        return (
            f"rows {sum(mine.values())} vs {sum(theirs.values())}; only here {sum(left.values())}: "
            f"{str(list(left)[:2])[:500]}; only there {sum(right.values())}: {str(list(right)[:2])[:500]}"
        )
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    session = build_session(master="local[8]", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    duck = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for key, fn in entry.queries().items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            problem = difference(session, duck, sf_dir, key, fn, oracle.get(key))
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '}{key} {time.time() - started:.1f}s {'' if key in oracle else '(rows)'} {problem or ''}", flush=True)
    print("bad:", bad)
