"""A query's rows against its SQL twin, as sorted rows with types."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def _plain(value):
    if value is None or value != value if isinstance(value, float) else value is None:
        return ("null",)
    if isinstance(value, float):
        return ("n", round(value, 6) + 0.0)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("n", float(value)) if abs(value) < 2**53 else ("i", value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(x) for x in value)
    return ("s", str(value))


def oracle_rows(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return names, rel.fetchall()


def differences(df, sql: str, folder: str) -> str:
    """Empty if columns and rows agree."""
    names, rows = oracle_rows(sql, folder)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in rows), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in order) for r in df.select(order).collect()), key=repr)
    if len(want) != len(got):
        extra = [x for x in got if x not in set(want)][:3]
        return f"{len(got)} rows, SQL has {len(want)}; only here: {extra}; only there: {[x for x in want if x not in set(got)][:3]}"
    for a, b in zip(got, want):
        if a != b and not all(x == y or (x[0] == y[0] == "n" and math.isclose(x[1], y[1], rel_tol=1e-9, abs_tol=2e-6)) for x, y in zip(a, b)):
            return f"{a} and {b}"
    return ""
