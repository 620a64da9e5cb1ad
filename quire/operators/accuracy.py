"""Accuracy of extracted articles by field, and its report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of the fields.
WEIGHTS = {"title": 0.3, "body": 0.4, "contributors": 0.2, "media": 0.1}


def article_accuracy(articles: DataFrame, **fields: DataFrame) -> DataFrame:
    """Per true article (doc_id, article_id): correct, total and accuracy of each field, from frames (doc_id, article_id, correct,
    total), and the weighted accuracy. An article that a field's frame lacks was not found: 0 of 1."""
    out = articles.select("doc_id", "article_id")
    for name, found in fields.items():
        found = found.select("doc_id", "article_id", F.col("correct").alias(f"{name}_correct"), F.col("total").alias(f"{name}_total"))
        out = out.join(found, ["doc_id", "article_id"], "left")
        out = out.withColumns({f"{name}_correct": F.coalesce(f"{name}_correct", F.lit(0).cast("long")), f"{name}_total": F.coalesce(f"{name}_total", F.lit(1).cast("long"))})
        out = out.withColumn(name, F.col(f"{name}_correct") / F.greatest(F.lit(1), F.col(f"{name}_total")))
    return out.withColumn("weighted", reduce(lambda a, b: a + b, (F.lit(w) * F.col(name) for name, w in WEIGHTS.items())))


def accuracy_report(accuracies: DataFrame) -> DataFrame:
    """Per document of article_accuracy(): correct, total and percentage of each field over its articles, and the mean weighted accuracy
    of the articles as a score and a percentage; percentages to two digits, halves to even."""
    sums = [F.sum(f"{name}_{x}").alias(f"{name}_{x}") for name in WEIGHTS for x in ("correct", "total")]
    out = accuracies.groupBy("doc_id").agg(F.count("*").alias("articles"), *sums, F.avg("weighted").alias("score"))
    percent = lambda x: F.bround(100 * x, 2)
    rates = {f"{name}_percent": percent(F.col(f"{name}_correct") / F.greatest(F.lit(1), F.col(f"{name}_total"))) for name in WEIGHTS}
    return out.withColumns(rates | {"percent": percent(F.col("score"))})


def serialised(report: DataFrame) -> DataFrame:
    """doc_id and the counts of a report as one JSON object."""
    counts = [F.struct(F.col(f"{name}_correct").alias("correct"), F.col(f"{name}_total").alias("total")).alias(name) for name in WEIGHTS]
    return report.select("doc_id", F.to_json(F.struct("doc_id", *counts)).alias("json"))
