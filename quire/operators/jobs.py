"""Job queue and workflow: ready jobs, pages of listings, statistics, rate limits, stages that may run, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages and the stages that each one needs; priorities of brands.
STAGES = {
    "preprocessing": ["ingestion"], "layout_analysis": ["preprocessing"], "ocr": ["layout_analysis"], "article_reconstruction": ["ocr", "layout_analysis"], "contributor_parsing": ["article_reconstruction"],
    "image_extraction": ["layout_analysis"], "export": ["article_reconstruction", "contributor_parsing", "image_extraction"], "evaluation": ["export"], "completed": ["evaluation"],
}
BRAND_PRIORITY = {"economist": 10, "time": 8, "vogue": 6}


def ready(jobs: DataFrame, as_of: str, slots: int) -> DataFrame:
    """Pending jobs that are due, most urgent first and oldest first among equals (a top-k)."""
    due = jobs.filter((F.col("status") == "pending") & (F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= F.lit(as_of).cast("timestamp_ntz"))))
    return due.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("job_id")).limit(slots)


def page(jobs: DataFrame, skip: int, size: int, status: str | None = None, brand: int | None = None) -> DataFrame:
    """One page of a listing, newest first."""
    for column, value in (("status", status), ("brand", brand)):
        jobs = jobs if value is None else jobs.filter(F.col(column) == value)
    return jobs.orderBy(F.desc("created_at"), F.asc("job_id")).offset(skip).limit(size)


def queue_statistics(jobs: DataFrame, most: int = 4) -> DataFrame:
    by = jobs.groupBy("status").agg(F.count("*").alias("n"))
    return by.withColumn("utilisation", F.when(F.col("status") == "running", F.col("n") / most).otherwise(0.0))


def rate_limited(jobs: DataFrame, per_day: int) -> DataFrame:
    """Per brand and day: runs, whether the limit is reached, and the next allowed day."""
    by = jobs.groupBy("brand", F.to_date("created_at").alias("day")).agg(F.count("*").alias("runs"))
    return by.select("brand", F.date_format("day", "yyyy-MM-dd").alias("day"), "runs", (F.col("runs") >= per_day).alias("limited"), F.when(F.col("runs") >= per_day, F.date_format(F.date_add("day", 1), "yyyy-MM-dd")).alias("next_allowed"))


def priority(brand: Column, age_hours: Column) -> Column:
    by_brand = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in BRAND_PRIORITY.items() for x in p)), F.lower(brand)), F.lit(0))
    return by_brand + F.when(age_hours < 1, 5).when(age_hours < 24, 2).otherwise(0)


def next_stages(steps: DataFrame, most: int = 3) -> DataFrame:
    """steps(job_id, stage, status, attempts): stages of each job whose needs are complete and that may run; a job's
    complete and its halted stages are two masks of bits, so that one aggregate decides."""
    names = list(dict.fromkeys(n for s, ds in STAGES.items() for n in (*ds, s)))
    bit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (n, 1 << k))), F.col("stage")), F.lit(0))
    halted = F.col("status").isin("completed", "in_progress") | ((F.col("status") == "failed") & (F.col("attempts") >= most))
    by = steps.filter("job_id IS NOT NULL").groupBy("job_id").agg(F.bit_or(F.when(F.col("status") == "completed", bit).otherwise(0)).alias("done"), F.bit_or(F.when(halted, bit).otherwise(0)).alias("halted"))
    mask = lambda of: sum(1 << names.index(n) for n in of)
    may_run = lambda s, ds: (F.col("done").bitwiseAND(mask(ds)) == mask(ds)) & (F.col("halted").bitwiseAND(mask([s])) == 0)
    return by.select("job_id", F.explode(F.array_compact(F.array(*(F.when(may_run(s, ds), s) for s, ds in STAGES.items())))).alias("stage"))


def quarantined(steps: DataFrame, accuracies: DataFrame, least: float = 0.999) -> DataFrame:
    """Jobs whose accuracy is too low or that failed in a critical stage."""
    failed = steps.filter(F.col("stage").isin("layout_analysis", "article_reconstruction") & (F.col("status") == "failed")).select("job_id")
    return accuracies.filter(F.col("accuracy") < least).select("job_id").union(failed).distinct()


def rolling_limit(runs: DataFrame, as_of: str, most: int = 1) -> DataFrame:
    """runs(brand, created_at): per brand, runs within the day before as_of, whether another is allowed, and from when on."""
    now = F.to_timestamp_ntz(F.lit(as_of))
    recent = (F.col("created_at") > now - F.expr("INTERVAL 1 DAY")) & (F.col("created_at") <= now)
    out = runs.groupBy("brand").agg(F.count_if(recent).alias("runs"), F.max(F.when(recent, F.col("created_at"))).alias("last"))
    return out.select("brand", "runs", (F.col("runs") < most).alias("allowed"), F.when(F.col("runs") >= most, F.col("last") + F.expr("INTERVAL 1 DAY")).alias("next_allowed"))
