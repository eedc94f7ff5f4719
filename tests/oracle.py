"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(row[i]) for i in order) for row in rows], key=repr)


def difference(df, sql: str, con) -> str | None:
    """None if both sides have the same columns, types and rows, else what differs."""
    mine = sorted_rows(df.columns, df.collect())
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    theirs = sorted_rows(names, answer.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        only_mine = [r for r in mine if r not in set(theirs)][:3]
        only_theirs = [r for r in theirs if r not in set(mine)][:3]
        return f"{len(mine)} and {len(theirs)} rows; only here {only_mine}; only there {only_theirs}"
    kinds = {d[0]: str(d[1]) for d in answer.description}
    types = dict(df.dtypes)
    return None if _same_types(types, kinds) else f"types {types} and {kinds}"


_KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def _same_types(types, kinds) -> bool:
    return all(_KINDS.get(types[c], types[c]) == kinds[c] for c in types)
