"""Run registered queries against their SQL on the same files."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPARK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def canonical(rows, order):
    def cell(v):
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, db, folder, fn, sql):
    """None when both agree, else what differs."""
    df = fn(spark, folder)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(cols) != sorted(names):
        return f"columns {sorted(cols)} != {sorted(names)}"
    for name, kind in df.dtypes:
        if SPARK_TYPES.get(kind, kind) != types[name]:
            return f"type of {name}: {kind} != {types[name]}"
    a = canonical(got, [cols.index(c) for c in sorted(cols)])
    b = canonical(want, [names.index(c) for c in sorted(cols)])
    if a == b:
        return None if a else "both empty"
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return f"rows {len(a)} != {len(b)} or values: {sorted(cols)} spark {only_a} sql {only_b}"


def main(names):
    import __spark_entry__ as entry
    from seqweave.session import build_session

    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = build_session(master=os.environ.get("CHECK_MASTER", "local[8]"), **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, db, folder, fn, sqls[name])
            else:
                problem = f"(no sql) {fn(spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        ok = problem is None
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
