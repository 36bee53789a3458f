"""Small helpers shared by the registered queries (output rounding on both engines)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 9


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column so the two engines' summation-order noise does not reach the result hash."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def sql_round(cols: list[str], doubles: set[str], digits: int = DIGITS) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" if c in doubles else c for c in cols)
