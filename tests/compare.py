"""Run registered queries against their SQL twin and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _canon(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, int):
        return (2, str(v))
    if isinstance(v, float):
        return (3, "nan" if math.isnan(v) else repr(v))
    return (4, str(v))


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree in columns, types and rows."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    got = df.collect()
    order = sorted(names)
    wi = [names.index(c) for c in order]
    gi = [df.columns.index(c) for c in order]
    a = sorted(tuple(_canon(r[i]) for i in gi) for r in got)
    b = sorted(tuple(_canon(r[i]) for i in wi) for r in want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            bad = [(c, p, q) for c, p, q in zip(order, x, y) if p != q]
            return f"first difference {str(bad)[:400]}"
    return None


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from mailsift.session import local_session

    folder = "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if argv and not any(a == name or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            bad = difference(df, con, sql[name]) if name in sql else None
            note = "ok" if name in sql else f"rows-only {df.count()}"
        except Exception as e:  # report and go on
            bad, note = f"{type(e).__name__}: {str(e)[:600]}", ""
        if bad:
            failed.append(name)
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.2f}s {bad or note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
