"""Compare a Spark result with a DuckDB result, column by name and row by value."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = DATA):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x


def _kind(type_name: str) -> str:
    t = type_name.lower()
    for kinds, name in (
        (("bigint", "int", "long", "hugeint", "smallint", "tinyint"), "int"),
        (("double", "float", "decimal"), "float"),
        (("string", "varchar"), "text"),
        (("boolean",), "bool"),
    ):
        if any(t.startswith(k) for k in kinds):
            return name
    return t


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    cursor = con.execute(sql)
    theirs = {c[0]: str(c[1]) for c in cursor.description}
    ours = dict(df.dtypes)
    if sorted(theirs) != sorted(ours):
        return f"columns {sorted(ours)} against {sorted(theirs)}"
    names = sorted(ours)
    places = [list(theirs).index(n) for n in names]
    right = sorted((tuple(_cell(r[i]) for i in places) for r in cursor.fetchall()), key=repr)
    left = sorted((tuple(_cell(x) for x in r) for r in df.select(*(f"`{n}`" for n in names)).collect()), key=repr)
    kinds = [n for n in names if _kind(theirs[n]) != _kind(ours[n])]
    if kinds:
        return f"types of {[(n, ours[n], theirs[n]) for n in kinds]}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"row {dict(zip(names, a))} against {dict(zip(names, b))}"
    return None if left else "both are empty"
