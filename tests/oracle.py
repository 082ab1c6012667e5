"""Run registered queries beside their SQL in DuckDB and compare names, types and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from factloom.plans import all_queries
from factloom.plans.registry import TABLES


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def kind(value: object) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def cell(value: object) -> tuple:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("null", "")
    if isinstance(value, float):
        return ("float", "0.0" if value == 0 else repr(value))
    return (kind(value), str(value))


def compare(spark, con, name: str, sf: str) -> tuple[str, str]:
    q = all_queries()[name]
    df = q.run(spark, sf)
    names = sorted(df.columns)
    mine = sorted(tuple(cell(r[n]) for n in names) for r in df.collect())
    if q.sql is None:
        return "rows", f"{len(mine)} rows"
    cur = con.execute(q.sql)
    found = [d[0] for d in cur.description]
    if sorted(found) != names:
        return "FAIL", f"columns {names} against {sorted(found)}"
    at = [found.index(n) for n in names]
    theirs = sorted(tuple(cell(row[i]) for i in at) for row in cur.fetchall())
    if mine != theirs:
        only = sorted(set(mine) - set(theirs))[:2]
        other = sorted(set(theirs) - set(mine))[:2]
        bad = sum(a != b for a, b in zip(mine, theirs))
        return "FAIL", f"{len(mine)} against {len(theirs)} rows, {bad} differ\n   {names}\n   spark {only}\n   duck  {other}"
    return ("ok" if mine else "EMPTY"), f"{len(mine)} rows"


def main(sf: str, wanted: list[str]) -> int:
    from factloom.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    bad = 0
    for name in all_queries():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            state, note = compare(spark, con, name, sf)
        except Exception as exc:
            state, note = "ERROR", str(exc)[:700]
        bad += state in ("FAIL", "ERROR", "EMPTY")
        print(f"{state:6}{name:34}{time.time() - t:7.2f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
