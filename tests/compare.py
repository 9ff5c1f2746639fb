"""Comparing a Spark result with the SQL result on the same tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(t: pa.DataType) -> str:
    return str(t).replace("large_", "").replace("_view", "")


def _rows(table: pa.Table, names: list[str]) -> Counter:
    return Counter(zip(*(table.column(n).to_pylist() for n in names))) if table.num_rows else Counter()


def differences(spark_table: pa.Table, sql_table: pa.Table) -> list[str]:
    """What differs: names, types or rows (order does not count)."""
    names, expected = sorted(spark_table.column_names), sorted(sql_table.column_names)
    if names != expected:
        return [f"columns {names} != {expected}"]
    out = [
        f"type of {n}: {a} != {b}"
        for n in names
        if (a := _plain(spark_table.schema.field(n).type)) != (b := _plain(sql_table.schema.field(n).type))
    ]
    if spark_table.num_rows != sql_table.num_rows:
        out.append(f"rows {spark_table.num_rows} != {sql_table.num_rows}")
    ours, theirs = _rows(spark_table, names), _rows(sql_table, names)
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        out.append(f"only in Spark {list(extra.items())[:3]}, only in SQL {list(missing.items())[:3]}")
    return out
