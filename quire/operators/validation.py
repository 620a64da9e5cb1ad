"""Validation of data sets: integrity, content quality, page ranges, coverage, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def integrity(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """blocks(doc_id, block_id), references(doc_id, block_id): duplicates, dangling and unreferenced ones, score 1 - .05 an issue."""
    dup = blocks.groupBy("doc_id", "block_id").count().groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.col("count") - 1).alias("duplicates"))
    dangling = references.join(blocks, ["doc_id", "block_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("dangling"))
    unused = blocks.distinct().join(references, ["doc_id", "block_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("unreferenced"))
    out = dup.join(dangling, "doc_id", "left").join(unused, "doc_id", "left").na.fill(0, ["dangling", "unreferenced"])
    issues = F.col("duplicates") + F.col("dangling")
    return out.withColumns({"score": F.greatest(F.lit(0.0), 1 - 0.05 * issues), "passed": issues == 0})


def content_quality(blocks: DataFrame) -> DataFrame:
    """Per document: empty and short texts, bad boxes, and the share of checks passed (three a block)."""
    empty, short = F.trim(F.coalesce("text", F.lit(""))) == "", F.length(F.trim("text")) < 3
    bad = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    out = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(empty).alias("empty"), F.count_if(~empty & short).alias("short"), F.count_if(bad).alias("bad_boxes"))
    return out.withColumn("score", F.greatest(F.lit(0.0), 1 - (F.col("empty") + F.col("bad_boxes")) / F.greatest(F.lit(1), 3 * F.col("blocks"))))


def page_overlaps(articles: DataFrame) -> DataFrame:
    """articles(doc_id, article_id, first_page, last_page): neighbours by first page whose ranges meet."""
    by = Window.partitionBy("doc_id").orderBy("first_page", "article_id", "last_page")
    rows = articles.select("*", F.lead("first_page").over(by).alias("next_first"), F.lead("article_id").over(by).alias("next_id"))
    return rows.filter("last_page >= next_first").select("doc_id", "article_id", "next_id")


def coverage(files: DataFrame) -> DataFrame:
    """files(brand, kind): counts of each kind, complete triplets, shares."""
    n = {k: F.count_if(F.col("kind") == k) for k in ("xml", "metadata", "pdf")}
    return files.groupBy("brand").agg(*(c.alias(k) for k, c in n.items()), F.least(*n.values()).alias("triplets"), (F.least(*n.values()) / F.greatest(F.lit(1), F.greatest(*n.values()))).alias("completeness"))


def truth_score(files: DataFrame) -> DataFrame:
    """files(id, errors, warnings, contributors, captions, confidence): 0 with errors, else by warnings, extras and confidence."""
    raw = (1 - 0.05 * F.col("warnings") + F.when(F.col("contributors") > 0, 0.1).otherwise(0.0) + F.when(F.col("captions") > 0, 0.1).otherwise(0.0)) * F.coalesce("confidence", F.lit(1.0))
    return files.select("id", F.when(F.col("errors") > 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))).alias("score"))


def check_scores(results: DataFrame) -> DataFrame:
    """results(check, score): mean per check with the mean of the means beside it."""
    per = results.groupBy("check").agg(F.avg("score").alias("score"))
    return per.crossJoin(F.broadcast(per.agg(F.avg("score").alias("overall"))))


def manifest(files: DataFrame) -> DataFrame:
    """files(kind, name): sorted names and counts by kind, a row each; the names of a kind as one JSON list."""
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.to_json(F.sort_array(F.collect_list("name"))).alias("names"))


def complexity_counts(spark, total: int, shares: dict[str, float]) -> DataFrame:
    """Documents per level: the floor of each share, the rest dealt out in order."""
    rows = spark.createDataFrame([(k, name, float(p)) for k, (name, p) in enumerate(shares.items())], "k int, level string, share double")
    floors = rows.withColumn("n", F.floor(F.lit(total) * F.col("share")).cast("int"))
    rest = floors.agg((F.lit(total) - F.sum("n")).alias("rest"))
    n = len(shares)
    return floors.crossJoin(F.broadcast(rest)).select("level", (F.col("n") + F.floor(F.col("rest") / n) + F.when(F.col("k") < F.col("rest") % n, 1).otherwise(0)).cast("int").alias("documents"))


# Roles that a contributor may have.
ROLES = ["author", "photographer", "illustrator", "editor", "correspondent"]


def article_structure(articles: DataFrame) -> DataFrame:
    """articles(id, first_page, last_page, titles, bodies, roles): counts of errors and warnings, and whether the article is valid."""
    title = F.get("titles", F.lit(0))
    count = lambda *tests: sum(F.when(t, 1).otherwise(0) for t in tests)
    one = F.size("titles") == 1
    errors = count(F.col("first_page") > F.col("last_page"), ~one, one & (F.trim(title) == ""), F.size("bodies") == 0)
    blank = F.size(F.filter("bodies", lambda b: F.trim(b) == ""))
    short = F.size(F.filter("bodies", lambda b: (F.trim(b) != "") & (F.length(b) < 50)))
    odd = F.size(F.filter("roles", lambda r: ~r.isin(ROLES)))
    warnings = count(F.col("last_page") - F.col("first_page") > 10, one & (F.length(title) > 300)) + blank + short + odd
    out = articles.select("id", errors.cast("int").alias("errors"), warnings.cast("int").alias("warnings"))
    return out.withColumn("valid", F.col("errors") == 0)


def dataset_quality(results: DataFrame) -> DataFrame:
    """results(errors, warnings, quality): mean of the qualities above 0, means of errors and warnings, files without either."""
    return results.agg(
        F.coalesce(F.avg(F.when(F.col("quality") > 0, F.col("quality"))), F.lit(0.0)).alias("quality"), F.avg("errors").alias("errors_per_file"), F.avg("warnings").alias("warnings_per_file"),
        F.count_if(F.col("errors") == 0).alias("error_free"), F.count_if(F.col("warnings") == 0).alias("warning_free"),
    )


def annotation_consistency(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, type, confidence string): per document and type, blocks and those whose confidence is no number of [0, 1]."""
    value = F.try_to_number("confidence", F.lit("S9999.999999")).cast("double")
    wrong = F.col("confidence").isNotNull() & F.coalesce(~value.between(0, 1), F.lit(True))
    return blocks.groupBy("doc_id", F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("blocks"), F.count_if(wrong).alias("confidence_issues"))
