"""Compare a registered Spark query with its DuckDB SQL on the same Parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    result = connection.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def _ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(
        table, key=lambda row: tuple((v is None, "" if v is None else repr(_coarse(v))) for v in row)
    )


def _coarse(value):
    return round(value, 4) + 0.0 if isinstance(value, float) else value


def differences(frame, sql: str, sf_dir: str, tolerance: float = 2e-8) -> list[str]:
    """Human-readable differences; floats may differ by the rounding unit."""
    columns, rows = duck_rows(sql, sf_dir)
    left = _ordered(frame.columns, [tuple(r) for r in frame.collect()])
    right = _ordered(columns, rows)
    if left[0] != right[0]:
        return [f"columns {sorted(set(left[0]) ^ set(right[0]))}"]
    if len(left[1]) != len(right[1]):
        return [f"rows {len(left[1])} != {len(right[1])}"]
    found = []
    for a, b in zip(left[1], right[1]):
        for name, x, y in zip(left[0], a, b):
            if x == y:
                continue
            close = isinstance(x, float) and isinstance(y, float) and math.isclose(
                x, y, rel_tol=1e-9, abs_tol=tolerance
            )
            found.append(f"{'close' if close else 'DIFF'} {name}: {x!r} != {y!r} in {a[:3]}")
    return found
