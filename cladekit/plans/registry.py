"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return keep


# Added before rounding down: one half, and a nudge far below the last digit shown so that
# exact halves go the same way in every engine.
HALF = 0.503


# Beyond this a scaled value no longer fits a BIGINT; such values, and NaN, are shown as they are.
WHOLE = 9e18


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round measures for display; whole numbers become BIGINT and FLOAT becomes DOUBLE."""
    scale = F.lit(10.0**digits)
    limit = WHOLE / 10.0**digits
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = c.cast("double")
            c = F.when(F.abs(c) < limit, F.floor(c * scale + HALF) / scale).otherwise(c)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def rounded(inner: str, columns: list[str] | str, digits: int = 6) -> str:
    """The same rounding around a SQL text."""
    names = columns.split() if isinstance(columns, str) else columns
    scale = f"CAST({10.0**digits!r} AS DOUBLE)"
    swaps = ", ".join(
        f'(CASE WHEN abs(CAST("{c}" AS DOUBLE)) < {WHOLE / 10.0**digits!r} THEN floor(CAST("{c}" AS DOUBLE) * {scale} + '
        f'CAST({HALF} AS DOUBLE)) / {scale} + 0.0 ELSE CAST("{c}" AS DOUBLE) END) AS "{c}"'
        for c in names)
    return f"SELECT * REPLACE ({swaps}) FROM ({inner}) AS shown"
