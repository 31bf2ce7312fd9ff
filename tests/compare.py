"""Run named queries against their SQL checks and compare the rows.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{root}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted(tuple(_cell(row[i]) for i in order) for row in rows),
    )


def check(spark, con, root: str, name: str) -> tuple[bool, str]:
    from tillscope.plans.catalogue import ORACLES, QUERIES

    found = QUERIES[name](spark, root)
    ours = _table(found.columns, [tuple(r) for r in found.collect()])
    if name not in ORACLES:
        return bool(ours[1]), f"{len(ours[1])} rows, no SQL check"
    result = con.execute(ORACLES[name])
    theirs = _table([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return False, f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        mine, other = set(ours[1]), set(theirs[1])
        only, missing = sorted(mine - other)[:3], sorted(other - mine)[:3]
        return False, f"rows {len(ours[1])} vs {len(theirs[1])}; only ours {only}; missing {missing}"
    return True, f"{len(ours[1])} rows"


if __name__ == "__main__":
    from tillscope.plans.catalogue import QUERIES
    from tillscope.session import build_session

    root, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        shuffle_partitions=8,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(root), []
    for name in names or QUERIES:
        began = time.time()
        try:
            good, note = check(spark, con, root, name)
        except Exception as error:  # report and go on with the next query
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if good else 'FAIL'} {name:28s} {time.time() - began:6.2f}s {note}", flush=True)
        if not good:
            bad.append(name)
    print("failed:", bad)
    sys.exit(bool(bad))
