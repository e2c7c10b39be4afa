"""Compare registered queries with their SQL in DuckDB.

    python tests/check_sql.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else repr(float(value))
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    if hasattr(value, "item"):
        return _plain(value.item())
    if isinstance(value, bool):
        return str(value)
    return repr(float(value)) if isinstance(value, int) else str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    cells = [tuple(_plain(v) for v in row) for row in frame[names].itertuples(index=False)]
    return sorted(cells, key=lambda r: tuple("" if c is None else c for c in r))


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when the same, else a short account of the difference."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    ours, theirs = rows_of(spark_frame), rows_of(sql_frame)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{sorted(spark_frame.columns)}\n   spark {str(a)[:600]}\n   sql   {str(b)[:600]}"
    return None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry_module

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    oracles = entry_module.oracle_sql()
    for name, run in entry_module.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            ours = run(spark, sf_dir).toPandas()
            spent = time.time() - began
            if name not in oracles:
                print(f"rows  {name}: {len(ours)} ({spent:.1f}s)")
                continue
            said = differences(ours, con.execute(oracles[name]).df())
        except Exception as error:  # report and go on with the next query
            said, ours, spent = f"{type(error).__name__}: {str(error)[:1500]}", [], 0
        bad += said is not None
        print(f"{'ok   ' if said is None else 'DIFF '} {name}: {len(ours)} rows ({spent:.1f}s)"
              + (f"\n   {said}" if said else ""), flush=True)
    print(f"{bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
