"""Compares a query with its SQL as sets of rows with equal columns, doubles to six digits."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str, tmp: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"memory_limit": "4GB", "temp_directory": tmp, "max_temp_directory_size": "2GB"})
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return repr(v)


def spark_rows(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(_plain(v) for v in r) for r in df.select(*cols).collect())


def duck_rows(con, sql: str, columns: list[str]) -> list[tuple]:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in sorted(columns)]
    return sorted(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
