"""Shards of near-equal size by sampled splitters, with DataFrame functions only.

Records are ordered by the MD5 of their text, then of their doc_id, so equal texts lie together but a group of them can be cut
anywhere; rows with the same text and doc_id, which are interchangeable, are ordered by a written number. Keys are drawn with a chance in proportion to their size; quantiles of the sample split the order into ranges;
ranges that turn out overfull are sampled again and subdivided. Exact row and byte totals of the ranges (a bounded number)
then place every record: its bytes before it, over all bytes, tell its shard. A shard differs from the mean by less than the
largest record. Only ids, sizes and hashes are shuffled, never texts; no group of equal texts stays in one task.

A null text counts as empty (size 1, checksum 0). Null ids are placed like an empty text of an id, repeated rows each on their own,
very long texts by their size; an empty table gives an empty one; other columns, whatever their names, are ignored. Law: bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._core import written

SHARDS = 8
#: Bytes of text aimed at in a range, and least and most ranges; keys drawn per range.
RANGE_BYTES, LEAST, MOST, DRAWN = 256 << 20, 1024, 8192, 8
_GRAIN = 1 << 30


#: What orders the records.
ORDER = ("key", "sub", "salt")
Place = tuple[int, int, int]


def _range_of(splits: list[Place]) -> Column:
    """How many splitters are not above a row's (key, sub, salt), by binary search in array literals."""
    if not splits:
        return F.lit(0)
    keys, subs, salts = (F.lit(np.array(x, np.int64)) for x in zip(*splits, strict=True))
    key, sub, salt = map(F.col, ORDER)
    steps = [1 << k for k in range(len(splits).bit_length() - 1, -1, -1)]

    def step(at: Column, size: Column) -> Column:
        k, s, x = (F.get(a, at + size - 1) for a in (keys, subs, salts))
        return at + F.when((k < key) | ((k == key) & ((s < sub) | ((s == sub) & (x <= salt)))), size).otherwise(F.lit(0))

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _drawn(rows: DataFrame, total: int, wanted: int, salt: int) -> list[tuple[Place, int]]:
    """About wanted keys of rows, each drawn with a chance in proportion to its size, with the size it stands for."""
    grain = F.pmod(F.xxhash64(*ORDER, F.lit(salt)), F.lit(_GRAIN))
    each = max(1, total // max(1, wanted))
    chosen = rows.filter(grain < F.least(F.lit(1.0), F.col("size") / each) * _GRAIN)
    return sorted(((r.key, r.sub, r.salt), max(each, r.size)) for r in chosen.select(*ORDER, "size").collect())


def _quantiles(sample: list[tuple[Place, int]], ranges: int) -> list[Place]:
    """ranges - 1 boundaries that part the weight of a sorted sample evenly."""
    if not sample:
        return []
    weight = np.cumsum([x[1] for x in sample])
    at = np.searchsorted(weight, np.arange(1, ranges) * weight[-1] / ranges)
    return sorted({sample[k][0] for k in at})


def splitters(rows: DataFrame, total: int, ranges: int) -> list[Place]:
    """Boundaries of rows(key, sub, salt, size) such that no range holds over twice its share, but for single rows."""
    splits = _quantiles(_drawn(rows, total, DRAWN * ranges, 0), ranges)
    share = 2 * total // ranges
    for salt in range(1, 6):
        sizes = rows.groupBy(_range_of(splits).alias("range")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        full = {r.range: r.size for r in sizes.filter((F.col("size") > share) & (F.col("n") > 1)).collect()}
        if not full or len(splits) >= 2 * MOST:
            break
        inside = rows.withColumn("range", _range_of(splits)).filter(F.col("range").isin(list(full)))
        more = {x for x, _ in _drawn(inside, sum(full.values()), DRAWN * len(full), salt)}
        if not more - set(splits):
            break
        splits = sorted(set(splits) | more)
    return splits


def _number(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), _number(text).alias("key"), _number(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("sub"), F.xxhash64(F.monotonically_increasing_id()).alias("salt")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = int(min(MOST, max(LEAST, total // RANGE_BYTES)))
    splits = splitters(rows, total, ranges)
    ranged = rows.withColumn("range", _range_of(splits))
    held = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.count("*"), F.sum("size")).collect())
    before, n, size = [], 0, 0
    for k, count, sum_ in held:
        before.append((k, n, size))
        n, size = n + count, size + sum_
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("range", "rows_before", "bytes_before")])
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, kind))  # at most a few ten thousand rows
    order = Window.partitionBy("range").orderBy(*ORDER)
    placed = ranged.join(offsets, "range")
    first = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("bytes_before")
    middle = 2 * first + F.col("size")  # twice the place of the record's middle
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * total)).cast("int"))
    placed = written(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.row_number().over(order) - 1 + F.col("rows_before")).alias("place")))
    begin = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("begin")))  # a row per shard
    return placed.join(begin, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("begin")).cast("long").alias("slot"))
