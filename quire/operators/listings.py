"""Listings: filtered, ordered rows, a page at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(rows: DataFrame, *order: Column, skip: int = 0, size: int = 50, **equal: object) -> DataFrame:
    """The rows whose columns equal the given values (None: any), in order, from skip on, at most size. The order should be total."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy(*order).offset(skip).limit(size)


def newest(rows: DataFrame, time: str, key: str, skip: int = 0, size: int = 50, **equal: object) -> DataFrame:
    """As listed(), the newest first; rows of one time by key."""
    return listed(rows, F.desc(time), F.asc(key), skip=skip, size=size, **equal)
