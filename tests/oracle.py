"""Compare a Spark query with its SQL on the same parquet: columns by name, rows as a multiset."""

from __future__ import annotations

import math
import os
import signal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        r = round(v, 9)
        return 0.0 if r == 0 else (int(r) if r == int(r) and abs(r) < 1e15 else r)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def kinds(dtypes):
    def one(t):
        t = t.lower()
        if t in ("tinyint", "smallint", "int", "bigint", "integer"):
            return "int"
        if t in ("double", "float"):
            return "float"
        if t in ("string", "varchar"):
            return "str"
        return t
    return {n: one(t) for n, t in dtypes}


def compare(df, con, sql):
    """(ok, message, rows)"""
    got = df.collect()
    cols = sorted(df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}", len(got)
    a = kinds(df.dtypes)
    b = kinds(types.items())
    diff = {c: (a[c], b[c]) for c in cols if a[c] != b[c]}
    if diff:
        return False, f"types {diff}", len(got)
    g = Counter(tuple(norm(r[c]) for c in cols) for r in got)
    at = [names.index(c) for c in cols]
    w = Counter(tuple(norm(r[i]) for i in at) for r in want)
    if g != w:
        x, y = list((g - w).items())[:3], list((w - g).items())[:3]
        return False, f"rows {len(got)} vs {len(want)}; cols {cols}; only spark {x}; only sql {y}", len(got)
    return True, "", len(got)


def main(argv):
    import __spark_entry__ as E
    from pyspark.sql import SparkSession
    sf = "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    verbose, argv = "-v" in argv, [a for a in argv if a != "-v"]
    limit = int(os.environ.get("QUERY_SECONDS", "60"))

    def late(*_):
        raise TimeoutError("too slow")

    signal.signal(signal.SIGALRM, late)
    for name, fn in q.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        signal.alarm(limit)
        try:
            df = fn(spark, sf)
            if name in o:
                ok, msg, n = compare(df, con, o[name])
            else:
                n = len(df.collect())
                ok, msg = True, "(rows only)"
        except Exception as e:  # report and go on
            ok, msg, n = False, f"{type(e).__name__}: {str(e)[:700]}", -1
            spark.sparkContext.cancelAllJobs()
        signal.alarm(0)
        bad += not ok
        if not ok or n == 0:
            print(f"{'ok ' if ok else 'BAD'} {name} rows={n} {time.time() - t:.1f}s {msg}", flush=True)
        elif verbose:
            print(f"ok  {name} {n} {time.time() - t:.1f}s")
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
