"""Run queries against their SQL counterparts: python tests/parity.py FOLDER [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples, columns in name order."""
    frame = frame[sorted(frame.columns)]
    return sorted(frame.itertuples(index=False, name=None), key=repr)


def nullable(frame: pd.DataFrame) -> pd.DataFrame:
    """Whole numbers with gaps come as floats from one side and as nullable integers from the other."""
    whole = {
        c: "Int64"
        for c in frame.columns
        if str(frame[c].dtype) in ("Int32", "Int64")
        or (frame[c].dtype == "float64" and frame[c].isna().any() and (frame[c].dropna() % 1 == 0).all())
    }
    frame = frame.astype(whole)
    return frame.astype({c: object for c in whole}).where(frame.notna(), None)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    spark_frame, sql_frame = nullable(spark_frame), nullable(sql_frame)
    for name in spark_frame.columns:
        if spark_frame[name].dtype != sql_frame[name].dtype:
            return f"type of {name}: {spark_frame[name].dtype} / {sql_frame[name].dtype}"
    ours, theirs = canonical(spark_frame), canonical(sql_frame)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a!r:.300} / {b!r:.300}"
    return None


def main(folder: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import test_session

    spark, connection, oracles, failed = test_session(), connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ours = query(spark, folder).toPandas()
            middle = time.time()
            if name not in oracles:
                outcome, problem = "rows", None
            else:
                problem = differences(ours, connection.execute(oracles[name]).df())
                outcome = "same" if problem is None else "DIFFERENT"
        except Exception as error:  # noqa: BLE001
            ours, middle, outcome, problem = [], time.time(), "ERROR", str(error)[:600]
        failed += outcome in ("DIFFERENT", "ERROR")
        print(
            f"{name:26} {outcome:10} {len(ours):8} rows  spark {middle - start:6.2f}s"
            f"  sql {time.time() - middle:6.2f}s  {problem or ''}",
            flush=True,
        )
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
