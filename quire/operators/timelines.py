"""Event-time analytics on batches: tumbling windows, sessions, rates, held alerts, bucket percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch(column: str = "ts"):
    """Whole seconds since 1970, without a time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))


def tumbling(events: DataFrame, seconds: int) -> DataFrame:
    at = F.floor(epoch() / seconds) * seconds
    return events.groupBy("event_type", at.alias("window_start")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: int) -> DataFrame:
    """Per user: sessions parted by silence of more than gap seconds."""
    rows = events.select("user_id", "event_id", epoch().alias("at"))
    by = Window.partitionBy("user_id").orderBy("at", "event_id")
    rows = rows.withColumn("start", F.coalesce((F.col("at") - F.lag("at").over(by) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("session", F.sum("start").over(by))
    return rows.groupBy("user_id", "session").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("events"))


def rates(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Events a second per type over windows."""
    return tumbling(events, seconds).select("event_type", "window_start", (F.col("n") / seconds).alias("rate"))


def held_alerts(events: DataFrame, kind: str, seconds: int, least: float, windows: int) -> DataFrame:
    """Runs of at least `windows` consecutive windows whose share of a kind of event is at least `least`."""
    at = F.floor(epoch() / seconds)
    rows = events.groupBy(at.alias("w")).agg((F.count_if(F.col("event_type") == kind) / F.count("*")).alias("share")).filter(F.col("share") >= least)
    # one row per window of time that reaches the share, so the global order is over few rows
    rows = rows.withColumn("island", F.col("w") - F.row_number().over(Window.orderBy("w")))
    return rows.groupBy("island").agg(F.min("w").alias("first_window"), F.count("*").alias("windows"), F.avg("share").alias("share")).filter(F.col("windows") >= windows).drop("island")


def bucket_percentile(events: DataFrame, share: float, width: float = 50.0) -> DataFrame:
    """The percentile per type as buckets give it: linear inside the first bucket that reaches the share."""
    counts = events.groupBy("event_type", F.floor(F.col("value") / width).alias("b")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("event_type").orderBy("b")
    rows = counts.withColumns({"upto": F.sum("n").over(by), "total": F.sum("n").over(Window.partitionBy("event_type"))})
    first = rows.filter(F.col("upto") >= share * F.col("total")).groupBy("event_type").agg(F.min(F.struct("b", "n", "upto", "total")).alias("r"))
    inside = (share * F.col("r.total") - (F.col("r.upto") - F.col("r.n"))) / F.col("r.n")
    return first.select("event_type", ((F.col("r.b") + inside) * width).alias("value"))
