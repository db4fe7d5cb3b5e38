"""Compare a registered query with its SQL on the same Parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan") if math.isnan(v) else (2, repr(v + 0.0))
    if isinstance(v, int):
        return (3, str(v))
    return (4, str(v))


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def type_differences(con, df, sql: str) -> list[tuple]:
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    have = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    return [(c, have[c], want.get(c)) for c in have if have[c] != want.get(c)]


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    odd = type_differences(con, df, sql)
    if odd:
        return False, f"types {odd}"
    cols = sorted(df.columns)
    mine = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(_cell(r[i]) for i in at) for r in cur.fetchall())
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(c, x[1], y[1]) for c, x, y in zip(cols, a, b) if x != y]
        return False, f"{len(bad)} of {len(mine)} rows differ, e.g. {diff[:5]} in {[v[1] for v in a][:8]}"
    return True, f"{len(mine)} rows"
