"""Run registered queries beside their SQL in DuckDB.

    python tests/compare.py [name-part ...]      (SF_DIR picks the data, default sf0.01)
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    records = [tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(records, key=lambda row: tuple(str(v) for v in row))


def close(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> list[str]:
    """What is unequal; 'near' marks rows that agree only within rounding."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"]
    if len(spark_frame) != len(sql_frame):
        return [f"rows {len(spark_frame)} / {len(sql_frame)}"]
    left, right = rows_of(spark_frame), rows_of(sql_frame)
    out = []
    for a, b in zip(left, right):
        if a != b:
            kind = "near" if all(close(x, y) for x, y in zip(a, b)) else "differs"
            out.append(f"{kind} {a} / {b}")
    return out


def main(parts: list[str]) -> int:
    import __spark_entry__ as contract
    from plumbline.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles, bad = contract.oracle_sql(), 0
    for name, build in contract.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            start = time.time()
            frame = build(spark, sf_dir).toPandas()
            took = time.time() - start
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        if name not in oracles:
            print(f"rows {name}: {len(frame)} rows {took:.2f}s", flush=True)
            continue
        try:
            wanted = con.execute(oracles[name]).df()
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name} sql: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        diff = differences(frame, wanted)
        kinds = [(c, str(frame[c].dtype), str(wanted[c].dtype)) for c in frame.columns
                 if c in wanted.columns and frame[c].dtype != wanted[c].dtype]
        bad += bool(diff)
        print(f"{'DIFF' if diff else 'ok'} {name}: {len(frame)} rows {took:.2f}s "
              f"{len(diff) if diff else ''} {diff[:2] if diff else ''} {kinds if kinds else ''}", flush=True)
    print(f"{bad} not equal")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
