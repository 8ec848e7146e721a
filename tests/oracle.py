"""Compares a DataFrame with DuckDB SQL over the same tables."""

import math
import os


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [normal(v) for v in value]
    return str(value)


def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        path += "/*.parquet" if os.path.isdir(path) else ""
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def same(df, connection, sql):
    columns = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in df.select(*columns).collect()), key=str)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = sorted((tuple(normal(row[i]) for i in at) for row in result.fetchall()), key=str)
    assert got == wanted
