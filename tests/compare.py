"""Runs registered queries and their SQL counterparts over one data folder and compares the rows."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def _plain(x):
    if x is None or x != x:
        return "NULL"
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26].replace("+00:00", "").removesuffix("T00:00:00")
    return repr(float(x)) if isinstance(x, float) else str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark, modules):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    out = []
    for m in modules:
        for name, sql in m.ORACLE.items():
            df = m.QUERIES[name](spark, DATA)
            got = _rows(df.columns, [tuple(r) for r in df.collect()])
            cursor = con.execute(sql)
            want = _rows([d[0] for d in cursor.description], cursor.fetchall())
            if got != want:
                out.append(name)
    return out
