"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(f"{sf_dir}/{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def _plain(v: object) -> object:
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    if isinstance(v, int):
        return float(v)
    return str(v)


def differences(found: DataFrame, con, sql: str) -> tuple[list, list, list[str]]:
    """Rows that only the query has, rows that only the SQL has, and columns that only one of them has."""
    rel = con.sql(sql)
    names = sorted(found.columns)
    odd = sorted(set(names) ^ set(rel.columns))
    if odd:
        return [], [], odd
    at = [rel.columns.index(n) for n in names]
    ours = Counter(tuple(_plain(r[n]) for n in names) for r in found.collect())
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    return list((ours - theirs).elements()), list((theirs - ours).elements()), []
