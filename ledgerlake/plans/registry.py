"""How registered queries are declared: a Spark query and, where SQL can say the same, its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Decimals that results are rounded to before they are compared.
DIGITS = 6


def query(oracle: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return put


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, and long counts kept; minus zero becomes zero."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def fine(df: DataFrame) -> DataFrame:
    """Doubles rounded to 1/1024: sums of decimals never lie halfway, so that every engine rounds them alike."""
    return df.select(*((F.round(F.col(f"`{c}`") * 1024) / 1024 + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def f(expression: str) -> str:
    """The oracle's spelling of ``fine`` for one column."""
    return f"round(({expression}) * 1024) / 1024 + 0.0"


def r(expression: str, digits: int = DIGITS) -> str:
    """The oracle's spelling of ``rounded`` for one column."""
    return f"round({expression}, {digits}) + 0.0"


def u(*key) -> str:
    """The oracle's spelling of ``simulation.uniform``."""
    return f"(CAST('0x' || md5(concat_ws('|', {', '.join(map(str, key))}))[1:13] AS BIGINT) / 4503599627370496.0)"
