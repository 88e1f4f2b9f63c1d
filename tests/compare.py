"""A query's rows held against its SQL in DuckDB, over the same files."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            at = path if os.path.isfile(path) else f"{path}/*.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
    return con


def _cell(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x if not hasattr(x, "item") else x.item()


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(_cell(v) for v in r) for r in zip(*cols, strict=True)), key=repr)


KINDS = {"int32": "int", "int64": "int", "int16": "int", "uint32": "int", "large_string": "string"}


def kinds(table) -> dict:
    return {f.name: KINDS.get(str(f.type), str(f.type)) for f in table.schema}


def differences(df, con, sql: str) -> str:
    """What differs, '' where nothing does."""
    mine = df.toArrow()
    other = con.sql(sql).to_arrow_table()
    if sorted(mine.column_names) != sorted(other.column_names):
        return f"columns {mine.column_names}, {other.column_names}"
    a, b = rows_of(mine), rows_of(other)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b), key=repr)[:3], sorted(set(b) - set(a), key=repr)[:3]
        return f"{len(a)} rows, {len(b)} in SQL; only here {str(only_a)[:600]}; only in SQL {str(only_b)[:600]}"
    if kinds(mine) != kinds(other):
        return f"types {kinds(mine)}, {kinds(other)}"
    return ""
