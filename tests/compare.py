"""Run registered queries next to their SQL and compare the results cell by cell."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(cell(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, cell(v)) for k, v in value.items()))
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value) + 0.0
    return str(value) if type(value).__name__ == "Decimal" else value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def negative_zeros(frame: pd.DataFrame) -> int:
    floats = frame.select_dtypes("float")
    return int(((floats == 0) & (1.0 / floats.where(floats == 0) < 0)).sum().sum()) if len(floats.columns) else 0


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    if negative_zeros(got) != negative_zeros(want):
        return f"{negative_zeros(got)} negative zeros != {negative_zeros(want)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tidewatch.session import local_session

    folder, patterns = argv[0], argv[1:]
    spark = local_session(cores="8")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if patterns and not any(p in name for p in patterns):
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            took = time.time() - start
            if name in oracles:
                problem = difference(got, con.execute(oracles[name]).df())
            else:
                problem = None if len(got) else "no rows"
        except Exception as error:  # report and go on with the next query
            took, problem = time.time() - start, f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {took:6.2f}s {'' if name in oracles else '(rows only)'} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
