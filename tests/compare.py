"""Rows of Spark and of DuckDB, made comparable."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(spark_df):
    names = sorted(spark_df.columns)
    return names, sorted((tuple(plain(x) for x in row) for row in spark_df.select(*(f"`{n}`" for n in names)).collect()), key=repr)


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(row[i]) for i in order) for row in cursor.fetchall()), key=repr)


def same(spark_df, con, sql):
    names, rows = rows_of(spark_df)
    want_names, want = rows_of_sql(con, sql)
    assert names == want_names
    assert len(rows) == len(want)
    different = [(a, b) for a, b in zip(rows, want, strict=True) if a != b]
    assert not different, different[:3]
