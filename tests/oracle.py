"""Compares a query's rows with DuckDB's for its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or str(x) in ("nan", "<NA>", "None"):
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(columns, found):
    return sorted(tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in found)


def duck(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    return rows(found.columns, found.fetchall())


def same(spark, build, sql, sf_dir):
    found = build(spark, sf_dir)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == duck(sql, sf_dir)
