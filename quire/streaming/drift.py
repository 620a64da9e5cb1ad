"""Structured Streaming forms: windowed accuracy with a watermark, incremental drift per metric, ingest of new files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.evaluation import ALERT, DRIFT, LEAST, TUNE, WINDOW


def windowed_accuracy(evaluations: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean accuracy per metric and event-time window; rows later than the watermark are left out."""
    rows = evaluations.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", size).alias("w"), "metric").agg(F.count("*").alias("n"), F.avg("accuracy").alias("accuracy")).select(F.col("w.start").alias("start"), "metric", "n", "accuracy")


def drift_stream(evaluations: DataFrame) -> DataFrame:
    """Per batch and metric: mean of the last ten values against the mean of all before, with the threshold flags.

    The state of a metric is its last values, their number and the sum of those that left the window, whatever the stream's length.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, total = state.get if state.exists else ("", 0, 0.0)
        values = [float(x) for x in last.split(",") if x]
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for x in rows.accuracy.tolist():
            values.append(x)
            if len(values) > WINDOW:
                total, n = total + values.pop(0), n + 1
        state.update((",".join(map(repr, values)), n, total))
        current = sum(values) / len(values)
        drop = (total / n if n else current) - current
        enough = len(values) >= LEAST
        yield pd.DataFrame([(key[0], len(values), current, drop, enough and drop >= DRIFT, enough and drop >= ALERT, enough and drop >= TUNE)], columns=["metric", "samples", "current", "accuracy_drop", "drift", "alert", "auto_tune"])

    out = "metric string, samples int, current double, accuracy_drop double, drift boolean, alert boolean, auto_tune boolean"
    return evaluations.select("metric", "ts", "event_id", "accuracy").groupBy("metric").applyInPandasWithState(update, out, "last string, n long, total double", "append", GroupStateTimeout.NoTimeout)


def start_ingest(files: DataFrame, good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None], checkpoint: str):
    """Streams binary files: each content once, PDF headers to one sink, the rest to quarantine."""
    fresh = files.withColumn("hash", F.sha2("content", 256)).withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["hash"])

    def split(batch: DataFrame, number: int) -> None:
        valid = F.decode(F.substring("content", 1, 5), "ISO-8859-1") == "%PDF-"
        good(batch.filter(valid), number)
        bad(batch.filter(~valid), number)

    return fresh.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
