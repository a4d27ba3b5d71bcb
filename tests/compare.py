"""Compare a query with its SQL twin as multisets of rows."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)) if v is None else v) for v in row)


def same(a, b, tol) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=tol, abs_tol=tol)
    return a == b


def mismatch(spark_df, con, sql: str, tol: float = 0.0) -> str | None:
    """None when equal, else a description."""
    names = sorted(spark_df.columns)
    left = sorted((tuple(r[n] for n in names) for r in spark_df.collect()), key=_key)
    result = con.execute(sql)
    got = [c[0] for c in result.description]
    if sorted(got) != names:
        return f"columns {names} against {sorted(got)}"
    order = [got.index(n) for n in names]
    right = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=_key)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    if not left:
        return "no rows"
    bad = [(a, b) for a, b in zip(left, right) if not all(same(x, y, tol) for x, y in zip(a, b))]
    return f"{len(bad)} of {len(left)} rows differ, first: {bad[0]}" if bad else None
