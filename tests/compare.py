"""Runs registered queries against their SQL on DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(columns: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


def same(spark, con, sf_dir: str, f, sql: str) -> tuple[bool, str]:
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows"
    diff = [(a, b) for a, b in zip(got[1], want[1], strict=False) if a != b][:2]
    return False, f"{got[0]} {want[0]} {len(got[1])} {len(want[1])} {diff}"
