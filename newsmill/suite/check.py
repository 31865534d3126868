"""Run registered queries next to their SQL and compare values."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> tuple[bool, str]:
    t = time.time()
    df = fn(spark, sf)
    mine = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return bool(mine), f"{name}: rows only, {len(mine)} rows, {took:.1f}s"
    rel = con.sql(sql)
    theirs = rel.fetchall()
    cols_a, cols_b = sorted(df.columns), sorted(rel.columns)
    if cols_a != cols_b:
        return False, f"{name}: columns differ {cols_a} / {cols_b}"
    a, b = rows_of(df.columns, mine), rows_of(rel.columns, theirs)
    if a == b:
        return bool(mine), f"{name}: equal, {len(mine)} rows, {took:.1f}s"
    only_a, only_b = list((a - b).items())[:2], list((b - a).items())[:2]
    return False, (
        f"{name}: differ, {len(mine)} / {len(theirs)} rows, {sum((a - b).values())} differ\n"
        f"   columns {cols_a}\n   spark  {str(only_a)[:700]}\n   sql    {str(only_b)[:700]}"
    )


def main(argv: list[str]) -> int:
    from newsmill.session import get_spark
    from newsmill.suite.base import ORACLES, QUERIES
    import newsmill.suite  # noqa: F401

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    wanted = argv[2:]
    spark = get_spark()
    con = duck(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, text = compare(spark, con, name, fn, ORACLES.get(name), sf)
        except Exception as e:  # report and go on
            ok, text = False, f"{name}: ERROR {type(e).__name__} {str(e)[:900]}"
        bad += not ok
        print("ok  " if ok else "BAD ", text, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
