"""Helpers of registered queries: one rounding for both engines, and oracle statements over the stand-in entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.standins import SQL

DIGITS = 6


def shaped(df: DataFrame) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*((F.round(F.col(c), DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def oracle(entities: str, body: str, columns: str) -> str:
    """body over the named entities; of the columns, those after a tilde are rounded as shaped() does."""
    out = ", ".join(f"round({c[1:]}, {DIGITS}) + 0.0::DOUBLE AS {c[1:]}" if c.startswith("~") else c for c in columns.split())
    return "WITH " + ", ".join([*(SQL[n] for n in entities.split()), f"result AS ({body})"]) + f" SELECT {out} FROM result"
