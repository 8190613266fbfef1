"""Run the registered queries and their SQL side by side."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.10g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r)
    )


def differences(spark, con, name, run, sql, folder) -> list[str]:
    frame = run(spark, folder)
    ours = normal(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    theirs = normal([d[0] for d in result.description], result.fetchall())
    out = []
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} != {theirs[0]}"]
    if len(ours[1]) != len(theirs[1]):
        out.append(f"rows {len(ours[1])} != {len(theirs[1])}")
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            out.append(f"spark {a}\n      duck  {b}")
            if len(out) > 3:
                break
    if not ours[1]:
        out.append("no rows")
    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    duck_types = {d[0]: str(d[1]) for d in result.description}
    for c, t in types.items():
        pair = (t, duck_types[c].upper())
        good = {
            "bigint": ("BIGINT", "NUMBER"), "int": ("INTEGER", "NUMBER"), "double": ("DOUBLE", "NUMBER"),
            "string": ("VARCHAR", "STRING"), "boolean": ("BOOLEAN", "BOOL"),
        }.get(t)
        if good and not any(g in pair[1] for g in good):
            out.append(f"type of {c}: spark {t}, duck {duck_types[c]}")
    return out


def main(pattern: str, folder: str) -> None:
    from facetframe.session import build_session
    import __spark_entry__ as entry

    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if not any(p in name for p in pattern.split(",")):
            continue
        started = time.time()
        try:
            if name in sql:
                found = differences(spark, con, name, run, sql[name], folder)
            else:
                found = [] if run(spark, folder).count() else ["no rows"]
        except Exception as e:
            found = [f"{type(e).__name__}: {str(e)[:900]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {time.time() - started:6.2f}s {name}" + ("" if name in sql else "  (no SQL)"))
        for line in found:
            print("     ", line)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "", sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01")
