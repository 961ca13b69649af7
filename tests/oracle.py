"""Compare a Spark result with DuckDB SQL on the same parquet tables."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

from arborist.sources.derived import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def _kind(name: str) -> str:
    n = name.lower()
    if any(k in n for k in ("struct", "[]", "array")):
        return "nested"
    if "string" in n or "varchar" in n:
        return "string"
    if "double" in n or "float" in n:
        return "double"
    if n.startswith("decimal"):
        return "decimal"
    if "bool" in n:
        return "bool"
    if "hugeint" in n:
        return "hugeint"
    if "bigint" in n:
        return "bigint"
    if "int" in n:
        return "int"
    if "timestamp" in n:
        return "timestamp"
    return n


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a description of the difference."""
    cur = con.execute(sql)
    dcols = [c[0] for c in cur.description]
    dtypes = {c[0]: _kind(str(c[1])) for c in cur.description}
    drows = cur.fetchall()
    scols = df.columns
    if sorted(scols) != sorted(dcols):
        return f"columns differ: spark {sorted(scols)} duck {sorted(dcols)}"
    stypes = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    bad = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
    order = sorted(scols)
    srows = Counter(tuple(norm(r[c]) for c in order) for r in df.collect())
    idx = [dcols.index(c) for c in order]
    duck = Counter(tuple(norm(r[i]) for i in idx) for r in drows)
    if srows != duck:
        a, b = list((srows - duck).items())[:3], list((duck - srows).items())[:3]
        return f"rows spark {sum(srows.values())} duck {sum(duck.values())} cols {order}\n  only spark {a}\n  only duck {b}"
    if bad:
        return f"types differ {bad}"
    return None
