"""Run a Spark query and its SQL statement on the same tables and compare rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, list):
        return tuple(_norm(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(row[i]) for i in order) for row in rows]
    # Text and whole numbers decide the order, so that the last digit of a float cannot move a row.
    exact = lambda t: tuple((v is None, str(type(v)), str(v)) for v in t if not isinstance(v, float))
    near = lambda t: tuple(str(round(v, 2)) for v in t if isinstance(v, float))
    return [columns[i] for i in order], sorted(out, key=lambda t: (exact(t), near(t)))


def same(x, y, tolerance: float) -> bool:
    if isinstance(x, float) and isinstance(y, float):
        return abs(x - y) <= tolerance * max(1.0, abs(y))
    return x == y


def compare(df, con, sql: str, tolerance: float = 0.0) -> str | None:
    """None when equal, else a short description of the first difference.

    ``tolerance`` admits a last-digit difference where a value lies exactly on a rounding border.
    """
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = rows_of(names, cur.fetchall())
    if got_cols != want_cols:
        return f"columns differ: {sorted(set(got_cols) ^ set(want_cols))}"
    kinds = dict(df.dtypes)
    names_of = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = [(c, kinds[c], types[c]) for c in got_cols if names_of.get(kinds[c]) != types[c]]
    if wrong:
        return f"types differ: {wrong}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for a, b in zip(got, want):
        bad = [(c, x, y) for c, x, y in zip(got_cols, a, b) if not same(x, y, tolerance)]
        if bad:
            return f"first difference at {a[:4]}: {bad[:5]}"
    return None
