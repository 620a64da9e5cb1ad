"""Evaluation analytics: accuracies of articles and documents, drift, trends, benchmarks, tuning and validation reports.

Every function takes and returns DataFrames and reads no clock: what depends on time takes the newest time of its input or an
explicit one. Aggregations combine before their shuffle; windows are only used per metric, brand or document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import sequences as Q

#: Weights of the fields of an article, and thresholds of a drop in accuracy.
WEIGHTS = {"title": 0.30, "body": 0.40, "contributors": 0.20, "media": 0.10}
DRIFT, ALERT, TUNE = 0.05, 0.10, 0.15
WINDOW, LEAST = 10, 5


def weighted_accuracy() -> Column:
    """The weighted accuracy of an article."""
    return sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))


def document_accuracy(articles: DataFrame) -> DataFrame:
    """Mean weighted accuracy of a document's articles (macro average)."""
    return articles.groupBy("doc_id").agg(F.avg(weighted_accuracy()).alias("accuracy"), F.count("*").alias("articles"))


def field_accuracy(articles: DataFrame, correct: float = 0.9) -> DataFrame:
    """Per field: correct articles over all (micro average); an article's field is correct from a share on."""
    long = articles.unpivot([], list(WEIGHTS), "field", "value")
    right = F.sum(F.when(F.col("value") >= correct, 1).otherwise(0))
    return long.groupBy("field").agg(right.alias("correct"), F.count("*").alias("total"), (right / F.greatest(F.lit(1), F.count("*"))).alias("accuracy"))


def run_averages(articles: DataFrame, success: float = 0.5) -> DataFrame:
    """Per brand: documents, successful ones, and averages over the successful ones (0 if none)."""
    docs = articles.groupBy("brand", "doc_id").agg(F.avg(weighted_accuracy()).alias("overall"), *(F.avg(c).alias(c) for c in WEIGHTS))
    good = F.col("overall") >= success
    mean = lambda c: (F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0.0)) / F.greatest(F.lit(1), F.count_if(good))).alias(f"avg_{c}")
    return docs.groupBy("brand").agg(F.count("*").alias("documents"), F.count_if(good).alias("successful"), *(mean(c) for c in ("overall", *WEIGHTS)))


def system_health(evaluations: DataFrame, articles: DataFrame, hours: int = 24) -> DataFrame:
    """One row on the last hours before the newest evaluation: volume, success rate, averages, drift alerts."""
    newest = evaluations.agg(F.max("ts").alias("newest"))
    recent = evaluations.crossJoin(F.broadcast(newest)).filter(F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {hours} HOUR"))
    per_doc = articles.groupBy("doc_id").agg(F.count("*").alias("articles"))
    joined = recent.join(per_doc, recent.event_id == per_doc.doc_id, "left")
    good = F.col("accuracy") >= 0.5
    return joined.agg(
        F.count("*").alias("documents_processed"), F.coalesce(F.sum("articles"), F.lit(0)).alias("articles_processed"), (F.count_if(good) / F.greatest(F.lit(1), F.count("*"))).alias("success_rate"),
        F.coalesce(F.avg(F.when(good, F.col("accuracy"))), F.lit(0.0)).alias("average_accuracy"), F.count_if(F.col("accuracy") < 0.2).alias("drift_alerts"),
    )


def rolling_window(evaluations: DataFrame, size: int = WINDOW, days: int = 7) -> DataFrame:
    """The newest rows of each metric within days of its newest one, numbered from the newest."""
    by = Window.partitionBy("metric")
    newest = evaluations.groupBy("metric").agg(F.max("ts").alias("newest"))
    recent = evaluations.join(F.broadcast(newest), "metric").filter(F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {days} DAY"))
    return recent.withColumn("rn", F.row_number().over(by.orderBy(F.desc("ts"), F.desc("event_id")))).filter(F.col("rn") <= size)


def median_baseline(evaluations: DataFrame, days: int = 30) -> DataFrame:
    """Median accuracy per metric over days before the newest evaluation of all."""
    newest = evaluations.agg(F.max("ts").alias("newest"))
    recent = evaluations.crossJoin(F.broadcast(newest)).filter(F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {days} DAY"))
    return recent.groupBy("metric").agg(F.median("accuracy").alias("baseline"))


def drift_report(evaluations: DataFrame, days: int = 7, lookback: int = 30) -> DataFrame:
    """Per metric: current (newest) accuracy, baseline, drop, threshold flags, t statistic of the window and its slope.

    The window's slope runs from its newest value to its oldest, as the values are listed; below 0.001 it counts as stable.
    """
    window = rolling_window(evaluations, days=days)
    n, spread = F.count("*"), F.stddev_samp("accuracy")
    stats = window.groupBy("metric").agg(
        F.max(F.when(F.col("rn") == 1, F.col("accuracy"))).alias("current"), n.alias("samples"), F.avg("accuracy").alias("mean"), spread.alias("spread"), F.regr_slope("accuracy", "rn").alias("slope")
    )
    out = stats.join(median_baseline(evaluations, lookback), "metric")
    drop = F.col("baseline") - F.col("current")
    enough = F.col("samples") >= LEAST
    flag = lambda least: enough & (drop >= least)
    trend = F.when(F.col("samples") < 3, "insufficient_data").when(F.abs("slope") < 0.001, "stable").when(F.col("slope") > 0, "improving").otherwise("declining")
    t = F.when(F.col("spread") > 0, (F.col("mean") - F.col("current")) / (F.col("spread") / F.sqrt("samples")))
    return out.select("metric", "samples", "current", "baseline", drop.alias("accuracy_drop"), flag(DRIFT).alias("drift"), flag(ALERT).alias("alert"), flag(TUNE).alias("auto_tune"), t.alias("t_stat"), "slope", trend.alias("trend"))


def drift_detections(evaluations: DataFrame) -> DataFrame:
    """One detection per evaluation: its drop below the metric's median, with the threshold flags."""
    middle = evaluations.groupBy("metric").agg(F.median("accuracy").alias("baseline"))
    drop = F.col("baseline") - F.col("accuracy")
    return evaluations.join(F.broadcast(middle), "metric").select("metric", "event_id", "ts", drop.alias("accuracy_drop"), (drop >= DRIFT).alias("drift"), (drop >= ALERT).alias("alert"), (drop >= TUNE).alias("auto_tune"))


def drift_status(detections: DataFrame) -> DataFrame:
    """The gravest flag of each metric's latest detection."""
    last = detections.groupBy("metric").agg(F.max(F.struct("ts", "event_id", "auto_tune", "alert", "drift")).alias("last"))
    status = F.when(F.col("last.auto_tune"), "auto_tuning_triggered").when(F.col("last.alert"), "alert_triggered").when(F.col("last.drift"), "drift_detected").otherwise("no_drift")
    return last.select("metric", F.col("last.event_id").alias("event_id"), status.alias("status"))


def drift_summary(detections: DataFrame, days: int = 7) -> DataFrame:
    newest = detections.agg(F.max("ts").alias("newest"))
    recent = detections.crossJoin(F.broadcast(newest)).filter(F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {days} DAY"))
    return recent.agg(
        F.count("*").alias("total_detections"), F.count_if("drift").alias("drift_count"), F.count_if("alert").alias("alert_count"), F.count_if("auto_tune").alias("auto_tune_count"),
        F.array_join(F.sort_array(F.collect_set("metric")), ",").alias("metrics_affected"), F.coalesce(F.avg("accuracy_drop"), F.lit(0.0)).alias("average_drop"),
    )


def accuracy_trend(evaluations: DataFrame) -> DataFrame:
    """Per metric: last, mean, least and greatest accuracy, and whether the last seven beat the earlier ones by 0.01."""
    newest = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("event_id")))
    top = evaluations.select("metric", "accuracy", newest.alias("rn")).filter("rn <= 7")  # limited before the shuffle
    late = top.groupBy("metric").agg(F.max(F.when(F.col("rn") == 1, F.col("accuracy"))).alias("current"), F.avg("accuracy").alias("recent"), F.sum("accuracy").alias("late"), F.count("*").alias("of_late"))
    all_ = evaluations.groupBy("metric").agg(F.avg("accuracy").alias("average"), F.min("accuracy").alias("least"), F.max("accuracy").alias("most"), F.sum("accuracy").alias("sum"), F.count("*").alias("n"))
    earlier = F.when(F.col("n") > F.col("of_late"), (F.col("sum") - F.col("late")) / (F.col("n") - F.col("of_late")))
    out = all_.join(late, "metric").select("metric", "current", "average", "least", "most", "recent", earlier.alias("earlier"))
    usual = F.coalesce("earlier", "average")
    return out.withColumn("trend", F.when(F.col("recent") > usual + 0.01, "improving").when(F.col("recent") < usual - 0.01, "declining").otherwise("stable"))


def window_significance(evaluations: DataFrame, level: float = 0.95) -> DataFrame:
    """Per metric, over its newest window: mean, t statistic against the newest value, two-sided p value, whether that is significant, and
    the confidence interval of the mean; nulls where the window has no spread."""
    window = rolling_window(evaluations)
    stats = window.groupBy("metric").agg(F.max(F.when(F.col("rn") == 1, F.col("accuracy"))).alias("current"), F.count("*").alias("samples"), F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("spread"))
    error = F.when(F.col("spread") > 0, F.col("spread") / F.sqrt("samples"))
    stats = stats.withColumn("t_stat", (F.col("mean") - F.col("current")) / error)
    stats = stats.withColumns({"p_value": Q.t_test("t_stat", "samples"), "reach": Q.t_quantile(F.lit(level), "samples") * error})
    return stats.select("metric", "samples", "mean", "t_stat", "p_value", (F.col("p_value") < 1 - level).alias("significant"), (F.col("mean") - F.col("reach")).alias("low"), (F.col("mean") + F.col("reach")).alias("high"))


def accuracy_history(evaluations: DataFrame, metric: str, days: int, brand: int | None = None) -> DataFrame:
    """The points of one metric in the days before its newest, oldest first."""
    rows = evaluations.filter(F.col("metric") == metric)
    rows = rows if brand is None else rows.filter(F.col("brand") == brand)
    newest = F.broadcast(rows.agg(F.max("ts").alias("newest")))
    return rows.crossJoin(newest).filter(F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {days} DAY")).select("event_id", "brand", "accuracy").orderBy("event_id")


def latest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order (a top-k, not a full sort)."""
    return rows.orderBy(*order).limit(n)


def percentiles(evaluations: DataFrame) -> DataFrame:
    shares = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    return evaluations.groupBy("metric").agg(*(F.expr(f"percentile(accuracy, {p})").alias(f"p{int(p * 100)}") for p in shares), F.stddev_pop("accuracy").alias("spread"))


# --- benchmarks and experiments


def levels(score: Column, production: float = 90, acceptable: float = 75, improvement: float = 50) -> Column:
    return F.when(score >= production, "production").when(score >= acceptable, "acceptable").when(score >= improvement, "needs_improvement").otherwise("failing")


def benchmark_overall(results: DataFrame) -> DataFrame:
    """results(brand, component, score): mean, median, production rate and coverage per brand."""
    level = levels(F.col("score"))
    return results.groupBy("brand").agg(
        F.avg("score").alias("average_score"), F.median("score").alias("median_score"), (F.count_if(level == "production") / F.count("*") * 100).alias("production_rate"),
        F.countDistinct("component").alias("coverage"), F.count("*").alias("metrics"),
    )


def benchmark_levels(results: DataFrame) -> DataFrame:
    """Counts per component and level as columns, best score, and whether any score is fit for production."""
    rows = results.withColumn("level", levels(F.col("score")))
    counts = rows.groupBy("component").pivot("level", ["production", "acceptable", "needs_improvement", "failing"]).count().na.fill(0)
    best = rows.groupBy("component").agg(F.max("score").alias("best_score"), F.bool_or(F.col("level") == "production").alias("production_ready"))
    return counts.join(best, "component")


def all_brands(results: DataFrame) -> DataFrame:
    """Per brand and in total (brand null): scores, ready share."""
    return results.rollup("brand").agg(F.count("*").alias("metrics"), F.avg("score").alias("average_score"), F.avg(F.when(F.col("score") >= 90, 1.0).otherwise(0.0)).alias("ready_share"))


def best_per_brand(experiments: DataFrame) -> DataFrame:
    return experiments.groupBy("brand").agg(F.count("*").alias("experiments"), F.max(F.struct("accuracy", (-F.col("experiment_id")).alias("order"))).alias("best")).select(
        "brand", "experiments", F.col("best.accuracy").alias("best_accuracy"), (-F.col("best.order")).alias("best_id")
    )


# --- tuning


def failure_patterns(articles: DataFrame, below: float = 0.8, least: int = 2) -> DataFrame:
    """Per failing field: severity (mean shortfall), frequency and up to five first examples; rarer patterns are left out."""
    docs = articles.groupBy("doc_id").agg(*(F.avg(c).alias(c) for c in WEIGHTS))
    failing = docs.unpivot(["doc_id"], list(WEIGHTS), "field", "accuracy").filter(F.col("accuracy") < below)
    first = failing.withColumn("rn", F.row_number().over(Window.partitionBy("field").orderBy("doc_id"))).filter("rn <= 5")
    examples = first.groupBy("field").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))
    stats = failing.groupBy("field").agg(F.avg(1 - F.col("accuracy")).alias("severity"), F.count("*").alias("frequency")).filter(F.col("frequency") >= least)
    return stats.join(examples, "field")


def holdout_accuracy(articles: DataFrame, least: float = 0.6, size: int = 50) -> DataFrame:
    """Weighted mean over the newest good articles; 0 without any."""
    good = articles.withColumn("accuracy", weighted_accuracy()).filter(F.col("accuracy") >= least)
    held = latest(good, size, F.desc("ts"), F.asc("doc_id"), F.asc("article_id"))
    return held.agg(F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("holdout_accuracy"), F.count("*").alias("held"))


def baseline_of_runs(evaluations: DataFrame, default: float = 0.5) -> DataFrame:
    """Mean accuracy per brand over 30 days, or the default."""
    brands = evaluations.select("brand").distinct()
    newest = F.broadcast(evaluations.agg(F.max("ts").alias("newest")))
    recent = evaluations.crossJoin(newest).filter("ts >= newest - INTERVAL 30 DAY").groupBy("brand").agg(F.avg("accuracy").alias("mean"))
    return brands.join(recent, "brand", "left").select("brand", F.coalesce("mean", F.lit(default)).alias("baseline"))


def tuning_statistics(runs: DataFrame) -> DataFrame:
    """runs(brand, status, gain): counts by outcome, mean gain of completed ones, distinct brands."""
    done = F.col("status") == "completed"
    return runs.agg(F.count("*").alias("runs"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "running").alias("running"), F.avg(F.when(done, F.col("gain"))).alias("average_gain"), F.countDistinct("brand").alias("brands"))


def parameter_grid(spark, sizes: dict[str, list[float]], most: int = 50) -> DataFrame:
    """The first `most` combinations of parameter values in the order of the lists (a stated cap of the operator)."""
    out = None
    for name, values in sizes.items():
        one = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], f"{name}_at int, {name} double")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    at = [f"{name}_at" for name in sizes]
    return out.orderBy(*at).limit(most).select(F.row_number().over(Window.orderBy(*at)).alias("rank"), *sizes)


def search(candidates: DataFrame, baseline: float, enough: float = 0.02) -> DataFrame:
    """candidates(rank, score) up to the first that beats the best before it (or the baseline) by more than enough."""
    before = F.coalesce(F.max("score").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(baseline))
    hits = candidates.withColumn("best_before", F.greatest(before, F.lit(baseline))).withColumn("hit", (F.col("score") - F.col("best_before") > enough).cast("int"))
    stopped = F.coalesce(F.sum("hit").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hits.withColumn("stopped", stopped).filter("stopped = 0").select("rank", "score", "best_before")


# --- quality reports


def precision_recall(pairs: DataFrame) -> DataFrame:
    """pairs(predicted, actual): precision over predictions, recall over attempts, F1, achievement of a 99 % target."""
    right, made, tried = F.count_if(F.col("predicted") & F.col("actual")), F.count_if("predicted"), F.count("*")
    out = pairs.agg(right.alias("correct"), made.alias("made"), tried.alias("attempted"))
    p = F.when(F.col("made") > 0, F.col("correct") / F.col("made")).otherwise(0.0)
    r = F.when(F.col("attempted") > 0, F.col("correct") / F.col("attempted")).otherwise(0.0)
    return out.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), (r / 0.99).alias("achievement"))


def threshold_checks(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """scores(metric, score) against a table of thresholds."""
    limits = scores.sparkSession.createDataFrame(sorted(thresholds.items()), "metric string, threshold double")
    return scores.join(F.broadcast(limits), "metric").select("metric", "score", "threshold", (F.col("score") >= F.col("threshold")).alias("passed"))


def difficulty_distribution(values: DataFrame) -> DataFrame:
    level = F.when(F.col("difficulty") < 0.2, "easy").when(F.col("difficulty") < 0.5, "medium").when(F.col("difficulty") < 0.8, "hard").otherwise("very_hard")
    return values.groupBy(level.alias("level")).agg(F.count("*").alias("elements"))


def ensemble_vote(votes: DataFrame) -> DataFrame:
    """votes(item_id, voter, label, confidence): majority label (ties: the first voter's), mean confidence and agreement."""
    per = votes.groupBy("item_id", "label").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.min("voter").alias("first_voter"))
    total = votes.groupBy("item_id").agg(F.count("*").alias("voters"))
    best = per.groupBy("item_id").agg(F.max(F.struct("n", (-F.col("first_voter")).alias("order"), "label", "confidence")).alias("b"))
    agreement = F.col("b.n") / F.col("voters")
    return best.join(total, "item_id").select("item_id", F.col("b.label").alias("label"), agreement.alias("agreement"), (F.col("b.confidence") * (0.7 + 0.3 * agreement)).alias("confidence"))


def confidence_histogram(values: DataFrame, bins: int = 10) -> DataFrame:
    """Counts in equal bins over [0, 1], the last one closed."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def confidence_uniformity(values: DataFrame) -> DataFrame:
    """Per group: 1 less the coefficient of variation, 1 below two values, 0 for a mean of 0."""
    mean = F.avg("confidence")
    score = F.when(F.count("*") < 2, 1.0).when(mean == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.stddev_pop("confidence") / mean))
    return values.groupBy("group").agg(score.alias("uniformity"), mean.alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.count_if(F.col("confidence") >= 0.8).alias("reliable"), F.count_if(F.col("confidence") < 0.5).alias("uncertain"))
