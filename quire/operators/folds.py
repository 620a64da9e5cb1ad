"""Folds over groups of rows in order, in Arrow batches: many groups to a batch, no frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH = 4096


def folded(rows: DataFrame, by: list[str], order: list[Column], step: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """step() of each group's rows, which are tuples in the order of the columns of rows, sorted by order. One group is held at a
    time; of all groups of a task only a batch."""
    places = [rows.columns.index(c) for c in by]
    out = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, found = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                mine = [row[k] for k in places]
                if mine != key:
                    if group:
                        found.extend(step(group))
                    if len(found) >= BATCH:
                        yield batch_of(found)
                        found = []
                    key, group = mine, []
                group.append(row)
        if group:
            found.extend(step(group))
        if found:
            yield batch_of(found)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
