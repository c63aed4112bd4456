"""Run registered queries against their SQL and report the first difference.

``python tests/oracle.py [sf] [name ...]`` prints a line per query.
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    import datetime
    import decimal

    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if v != 0 else 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


def compare(spark_df, con, sql):
    a_names, a = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    b_names, b = normal(names, cur.fetchall())
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}", len(a)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}", len(a)
    for x, y in zip(a, b):
        if x != y:
            diff = [(n, p, q) for n, p, q in zip(a_names, x, y) if p != q]
            return f"value {diff} in {x}", len(a)
    return None, len(a)


if __name__ == "__main__":
    import __spark_entry__ as e
    from trialstats.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    con = connect(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    for name, fn in qs.items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            if name in sqls:
                bad, n = compare(fn(spark, sf_dir), con, sqls[name])
            else:
                bad, n = None, len(fn(spark, sf_dir).collect())
            tag = "rows-only" if name not in sqls else ("ok" if bad is None else "DIFF " + bad[:600])
        except Exception as exc:  # report and go on
            tag, n = f"ERROR {type(exc).__name__}: {str(exc)[:900]}", -1
        print(f"{name:32s} {n:8d} rows {time.time() - t:7.2f}s {tag}", flush=True)
