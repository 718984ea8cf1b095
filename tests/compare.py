"""Runs queries and their SQL side by side: python tests/compare.py [--sf DIR] [NAME...]"""

from __future__ import annotations

import hashlib
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def cell(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("\x1f".join(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, folder, f, sql):
    t = time.time()
    df = f(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"{name}: rows {len(rows)}, no SQL, {took:.1f} s", len(rows) > 0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"{name}: COLUMNS {sorted(df.columns)} / {sorted(names)}", False
    a, b = canon(rows, df.columns), canon(want, names)
    same = hashlib.sha256("\n".join(a).encode()).digest() == hashlib.sha256("\n".join(b).encode()).digest()
    extra = "" if same else f"\n   only spark {len(set(a) - set(b))}: {[x.split(chr(31)) for x in sorted(set(a) - set(b))[:2]]}\n   only sql {len(set(b) - set(a))}: {[x.split(chr(31)) for x in sorted(set(b) - set(a))[:2]]}"
    return f"{name}: {'same' if same else 'DIFFERENT'} rows {len(a)} / {len(b)}, {took:.1f} s{extra}", same


def main(args):
    import traceback

    import __spark_entry__ as e
    from driftaudit.session import local_session

    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    spark, con = local_session(), duck(folder)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name in [n for n in qs if not args or any(n == a or a.endswith("*") and n.startswith(a[:-1]) for a in args)]:
        try:
            text, ok = compare(spark, con, name, folder, qs[name], sqls.get(name))
        except Exception:
            text, ok = f"{name}: FAILED " + " ".join(traceback.format_exc().split("JVM stacktrace")[0].split())[-330:], False
        bad += not ok
        if not ok or len(args) > 0:
            print(text, flush=True)
    print(f"{bad} bad of {len(qs)}; SQL without query: {sorted(set(sqls) - set(qs))}")


if __name__ == "__main__":
    main(sys.argv[1:])
