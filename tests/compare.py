"""Run registered queries on Spark and their check SQL on DuckDB and compare.

    python tests/compare.py [name-part ...] [--sf 0.01] [--times]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    if type(value).__name__ == "Decimal":
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def _family(kind: str) -> str:
    kind = kind.lower()
    for family, marks in {"int": ("int", "long", "short"), "float": ("double", "float"),
                          "decimal": ("decimal",), "bool": ("bool",), "text": ("varchar", "string")}.items():
        if any(m in kind for m in marks):
            return family
    return kind


def compare(spark, con, name: str, query, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query.build(spark, sf_dir)
    cols = sorted(df.columns)
    left = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    if query.sql is None:
        return None if left else "no rows"
    rel = con.sql(query.sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} against {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    for field in df.schema.fields:
        ours, theirs = _family(field.dataType.simpleString()), _family(kinds[field.name])
        if ours != theirs:
            return f"type of {field.name}: {field.dataType.simpleString()} against {kinds[field.name]}"
    at = [rel.columns.index(c) for c in cols]
    right = sorted(tuple(_cell(r[i]) for i in at) for r in rel.fetchall())
    if left == right:
        return None if left else "equal but empty"
    a, b = set(left), set(right)
    return (f"{cols}\n rows {len(left)} against {len(right)}\n only Spark {len(a - b)}: {sorted(a - b)[:3]}"
            f"\n only SQL {len(b - a)}: {sorted(b - a)[:3]}")


def main() -> None:
    from fiscalis.plans import all_queries
    from fiscalis.session import local_session

    args = sys.argv[1:]
    sf = args[args.index("--sf") + 1] if "--sf" in args else "0.01"
    parts = [a for i, a in enumerate(args) if not a.startswith("--") and (i == 0 or args[i - 1] != "--sf")]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = total = 0
    for name, query in all_queries().items():
        if parts and not any(p in name for p in parts):
            continue
        total += 1
        start = time.time()
        try:
            problem = compare(spark, con, name, query, sf_dir)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        took = time.time() - start
        if problem:
            bad += 1
            print(f"DIFF {name} ({took:.1f}s): {problem}", flush=True)
        elif "--times" in args or took > 8:
            print(f"ok   {name} ({took:.1f}s){'' if query.sql else ' rows only'}", flush=True)
    print(f"{total - bad} of {total} equal")
    spark.stop()


if __name__ == "__main__":
    main()
