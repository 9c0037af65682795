"""Runs a query beside its SQL."""

import glob
import os

import duckdb


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    rows = con.execute(sql).fetchall()
    return [d[0] for d in con.description], rows


def canonical(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def check(spark, query, sql: str, sf_dir: str) -> int:
    found = query(spark, sf_dir)
    rows = found.collect()
    names, expected = sql_rows(sql, sf_dir)
    assert sorted(names) == sorted(found.columns)
    assert canonical(found.columns, rows) == canonical(names, expected)
    return len(rows)
