"""Compares a query's rows with those of its SQL, as the driver does: by sorted columns, without order."""

import math
from pathlib import Path

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def differences(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection(sf_dir).execute(sql)
    theirs = rows([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} and {len(theirs[1])} rows; {sorted(set(mine[1]) - set(theirs[1]), key=repr)[:3]}, {sorted(set(theirs[1]) - set(mine[1]), key=repr)[:3]}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1], strict=True) if a != b and not all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5) for x, y in zip(a, b, strict=True))]
    return f"{len(bad)} of {len(mine[1])} rows: {bad[:3]}" if bad else ""
