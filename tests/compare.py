"""Compare a query with its SQL, as bags of rows with columns in name order."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(df) -> list[tuple]:
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, str(v)) for v in r])


def _bag(names: list[str], rows: list) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(
        tuple(str(row[i]) for i in order) for row in rows
    )


def spark_rows(df) -> tuple[list[str], Counter]:
    return _bag(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    return _bag([d[0] for d in cur.description], cur.fetchall())


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    names, ours = spark_rows(df)
    other_names, theirs = sql_rows(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if ours != theirs:
        missing, extra = theirs - ours, ours - theirs
        return (
            f"{ours.total()} rows against {theirs.total()}; only ours "
            f"{list(extra.items())[:3]}, only theirs {list(missing.items())[:3]}"
        )
    return None
