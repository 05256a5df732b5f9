"""Compares a query's rows with those of its DuckDB SQL, whatever their order."""

import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return c


def rows(names, data):
    def plain(x):
        return repr(float(x)) if isinstance(x, float) else repr(list(x)) if isinstance(x, (list, tuple)) else repr(x)

    return sorted(tuple(plain(r[n]) for n in sorted(names)) for r in data)


def same(df, connection, sql: str) -> None:
    got = [r.asDict() for r in df.collect()]
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(df.columns) == sorted(names)
    assert rows(names, got) == rows(names, want)
