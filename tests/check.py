"""Run registered queries next to their SQL twins and compare whole results.

    python tests/check.py [sf dir] [query …]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    names = sorted(spark_df.columns)
    got = [tuple(cell(v) for v in r) for r in spark_df.select(*[f"`{n}`" for n in names]).collect()]
    relation = con.sql(sql)
    if sorted(relation.columns) != names:
        return f"columns {names} != {sorted(relation.columns)}"
    picked = ", ".join(f'"{n}"' for n in names)
    want = [tuple(cell(v) for v in r) for r in con.sql(f"SELECT {picked} FROM ({sql})").fetchall()]
    if sorted(got) == sorted(want):
        return None
    missing = sorted(set(want) - set(got))[:2]
    extra = sorted(set(got) - set(want))[:2]
    return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {missing}"


def main() -> int:
    import __spark_entry__ as entry
    from tonetide.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failures = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in oracles:
                problem = compare(frame, con, oracles[name])
            else:
                problem = None if frame.count() >= 0 else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failures += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print("failures", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main() > 0)
