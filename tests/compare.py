"""Run registered queries beside their SQL and compare rows, whatever their order.

    python tests/compare.py <folder with the tables> [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from paperquay.plans.catalog import ORACLE, QUERIES  # noqa: E402
from paperquay.plans.fixtures import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "is_finite"):
        return round(float(v), 6)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    return str(v)


def rows(cols, data) -> list[tuple]:
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def check(spark, con, folder: str, name: str) -> str:
    """'' when both sides agree, else what differs."""
    df = QUERIES[name](spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        return ""
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; first only here {[r for r in got if r not in set(want)][:2]}; missing {[r for r in want if r not in set(got)][:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else ""


def main() -> int:
    from paperquay.session import build_session

    folder, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con, failed = connect(folder), 0
    for name in QUERIES:
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        start = time.time()
        try:
            problem = check(spark, con, folder, name)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
