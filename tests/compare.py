"""Run catalogue queries next to their SQL twins: python tests/compare.py [folder] [name...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def register_tables(connection: duckdb.DuckDBPyConnection, folder: str) -> None:
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted, one spelling per value."""

    def cell(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "∅"
        if isinstance(value, float):
            # Whole numbers with gaps arrive as floats from one reader and as integers from another.
            return str(int(value)) if float(value).is_integer() else repr(float(value))
        if isinstance(value, pd.Timestamp):
            return value.isoformat()
        return str(value)

    ordered = frame[sorted(frame.columns)]
    text = ordered.astype(object).apply(lambda column: column.map(cell))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, oracle_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(oracle_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(oracle_rows.columns)}"
    if len(spark_rows) != len(oracle_rows):
        return f"{len(spark_rows)} rows and {len(oracle_rows)}"
    left, right = normal(spark_rows), normal(oracle_rows)
    unequal = left != right
    if unequal.to_numpy().any():
        rows = unequal.any(axis=1)
        return f"{rows.sum()} rows differ\n{left[rows].head(3)}\n{right[rows].head(3)}"
    return None


def typed(column: pd.Series) -> str:
    kind = str(column.dtype)
    if kind != "object":
        return kind.replace("datetime64[ns]", "datetime64[us]")
    return type(next((v for v in column if v is not None), None)).__name__


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    import __spark_entry__ as contract

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    register_tables(connection, folder)
    oracles = contract.oracle_sql()
    failed = 0
    for name, run in contract.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            rows = run(spark, folder).toPandas()
        except Exception as error:
            failed += 1
            print(f"{name}: ERROR {str(error)[:1500]}", flush=True)
            continue
        seconds = time.time() - started
        if name not in oracles:
            print(f"{name}: no twin, {len(rows)} rows, {seconds:.2f} s", flush=True)
            continue
        expected = connection.execute(oracles[name]).df()
        problem = difference(rows, expected)
        failed += problem is not None
        types = {
            c: (typed(rows[c]), typed(expected[c]))
            for c in rows.columns
            if c in expected and typed(rows[c]) != typed(expected[c])
        }
        print(f"{name}: {problem or 'equal'}, {len(rows)} rows, {seconds:.2f} s {types or ''}",
              flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main(*sys.argv[1:]))
