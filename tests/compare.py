"""Run every registered query beside its DuckDB counterpart: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import datetime
import pathlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in one order, numbers and times in one form."""
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        column = frame[name]
        if any(type(x) is datetime.date for x in column):
            column = pd.to_datetime(column)
        if pd.api.types.is_datetime64_any_dtype(column):
            frame[name] = column.dt.strftime("%Y-%m-%d %H:%M:%S.%f").fillna("")
        elif pd.api.types.is_float_dtype(column):
            frame[name] = column.map(lambda x: "" if pd.isna(x) else repr(float(x)))
        else:
            frame[name] = column.map(lambda x: "" if pd.isna(x) else str(x))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def whole_numbers(frame: pd.DataFrame, like: pd.DataFrame) -> pd.DataFrame:
    """Nullable integer columns, which pandas makes floats, as integers."""
    for name in frame.columns:
        if name in like.columns and pd.api.types.is_float_dtype(frame[name]) and not pd.api.types.is_float_dtype(like[name]):
            frame[name] = frame[name].astype("Int64")
    return frame


# DuckDB names of the types that registered queries return.
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def type_differences(spark_types: dict[str, str], duck_types: dict[str, str]) -> str | None:
    wrong = {n: (t, duck_types.get(n)) for n, t in spark_types.items() if TYPES.get(t, t) != duck_types.get(n)}
    return f"types differ: {wrong}" if wrong else None


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in pathlib.Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def differences(spark_rows: pd.DataFrame, duck_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(duck_rows.columns):
        return f"columns {sorted(spark_rows.columns)} != {sorted(duck_rows.columns)}"
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows != {len(duck_rows)}"
    left = normal(whole_numbers(spark_rows, duck_rows))
    right = normal(whole_numbers(duck_rows, spark_rows))
    unequal = (left != right).any(axis=1)
    if unequal.any():
        return f"{unequal.sum()} of {len(left)} rows differ:\n{left[unequal].head(3).to_string()}\n{right[unequal].head(3).to_string()}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as registered

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registered.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            rows = registered.queries()[name](spark, folder)
            types = dict(rows.dtypes)
            got = rows.toPandas()
            took = time.time() - start
            want = connection.execute(registered.oracle_sql()[name])
            duck_types = {d[0]: str(d[1]) for d in want.description}
            result = type_differences(types, duck_types) or differences(got, want.df())
        except Exception as error:
            result, took, got = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - start, []
        failed += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {len(got)} rows {took:.2f}s {result or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
