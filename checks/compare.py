"""Run queries against their SQL counterparts: ``python -m checks.compare <sf_dir> [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracles import all_oracles
from checks.queries import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _normal(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = []
    for values in frame[columns].itertuples(index=False, name=None):
        row = []
        for value in values:
            if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
                row.append("∅")
            elif hasattr(value, "isoformat"):
                row.append(value.isoformat()[:10] if str(value).endswith("00:00:00") else str(value))
            elif isinstance(value, bool) or type(value).__name__ == "bool_":
                row.append(str(bool(value)))
            elif isinstance(value, (int, float)) or hasattr(value, "dtype"):
                row.append(repr(float(value)))
            else:
                row.append(str(value))
        rows.append(tuple(row))
    return sorted(rows)


def differences(spark, connection, sf_dir: str, name: str) -> str | None:
    """None when both sides agree, else a short description."""
    expected = connection.sql(all_oracles()[name]).df().astype(object)
    frame = all_queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    actual = pd.DataFrame(rows, columns=frame.columns, dtype=object)
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} != {sorted(expected.columns)}"
    left, right = _normal(actual), _normal(expected)
    if left == right:
        return None
    only_left = [r for r in left if r not in set(right)][:3]
    only_right = [r for r in right if r not in set(left)][:3]
    return f"rows {len(left)} / {len(right)}; only Spark {only_left}; only SQL {only_right}"


def main() -> int:
    from bench import session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, connection, failed = session("8"), duck(sf_dir), 0
    for name in names or all_queries():
        if name not in all_oracles():
            continue
        start = time.monotonic()
        try:
            problem = differences(spark, connection, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:28s} {time.monotonic() - start:6.2f}s {problem or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
