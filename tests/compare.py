"""Compare a Spark result with DuckDB's, as sorted rows of columns in name order."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import tempfile

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"SET temp_directory='{tempfile.mkdtemp(prefix='spark-')}'")
    con.execute("SET memory_limit='10GB'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, float) and x == 0:
        return 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(v is not None, str(type(v)), v if not isinstance(v, bool) else int(v)) if not isinstance(v, tuple) else (True, "t", str(v)) for v in r])


def differences(df, con, sql: str, show: int = 3) -> list[str]:
    names, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names2, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != names2:
        return [f"columns {names} and {names2}"]
    if len(got) != len(want):
        return [f"{len(got)} rows, {len(want)} expected", *map(str, [r for r in got if r not in set(want)][:show]), "--", *map(str, [r for r in want if r not in set(got)][:show])]
    kinds = [(n, type(a), type(b)) for a, b in zip(got, want, strict=True) for n, a, b in zip(names, a, b, strict=True) if a is not None and b is not None and type(a) is not type(b)]
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    out = [f"types {kinds[0]}"] if kinds else []
    return out + ([f"{len(bad)} of {len(got)} rows differ", *(f"{a}\n    {b}" for a, b in bad[:show])] if bad else [])
