"""Scoring of extracted documents against ground truth, and OCR error analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import sequences as Q
from quire.functions import text as T

WER_LIMIT = 0.001


def title_accuracy(pairs: DataFrame) -> DataFrame:
    """pairs(id, truth, found): exact equality of normalised titles."""
    a, b = T.normalised_title(F.col("truth")), T.normalised_title(F.col("found"))
    return pairs.select("id", a.alias("truth_title"), (a == b).alias("correct"))


def body_accuracy(pairs: DataFrame) -> DataFrame:
    """pairs(id, truth, found): word error rate against its limit; without truth, right iff nothing was found."""
    rate = Q.wer("truth", "found")
    empty = F.coalesce(F.col("truth"), F.lit("")) == ""
    rows = pairs.select("id", empty.alias("empty"), (F.coalesce(F.col("found"), F.lit("")) == "").alias("none"), rate.alias("wer"))
    return rows.select("id", "wer", F.when(F.col("empty"), F.col("none")).otherwise(F.col("wer") <= WER_LIMIT).alias("correct"))


def contributor_accuracy(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Share of an article's contributors (id, name, role) found with equal normalised name and role; a match is right only if
    both agree, so an equi-join on both decides."""
    key = [T.normalised_name(F.col("name")).alias("n"), F.lower(F.trim("role")).alias("r")]
    hits = found.select("id", *key).distinct().withColumn("hit", F.lit(1))
    rows = truth.select("id", *key).join(hits, ["id", "n", "r"], "left")
    return rows.groupBy("id").agg(F.count("hit").alias("correct"), F.count("*").alias("total"), (F.count("hit") / F.count("*")).alias("accuracy"))


def matched_articles(truth: DataFrame, found: DataFrame, least: float = 0.7) -> DataFrame:
    """Each true article (doc_id, article_id, title) with a found one of its document: the same id, else the likeliest title above
    the least ratio. Titles are compared within a document only, and only for articles without an equal id."""
    t = truth.select("doc_id", "article_id", T.normalised_title(F.col("title")).alias("t"))
    f = found.select("doc_id", F.col("article_id").alias("found_id"), T.normalised_title(F.col("title")).alias("f"))
    exact = t.join(f, (t.doc_id == f.doc_id) & (t.article_id == f.found_id), "left").select(t.doc_id, "article_id", "t", "found_id")
    rest = exact.filter("found_id IS NULL").select("doc_id", "article_id", "t")
    scored = rest.join(f, "doc_id").withColumn("ratio", Q.ratio("t", "f")).filter(F.col("ratio") > least)
    best = scored.groupBy("doc_id", "article_id").agg(F.max(F.struct("ratio", (-F.col("found_id")).alias("m"))).alias("b")).select("doc_id", "article_id", (-F.col("b.m")).alias("best_id"))
    return exact.join(best, ["doc_id", "article_id"], "left").select("doc_id", "article_id", F.coalesce("found_id", "best_id").alias("found_id"))


def media_accuracy(images: DataFrame, media: DataFrame, right: float = 0.8) -> DataFrame:
    """Share of true images (doc_id, page, image_id, box, caption) whose best found medium scores above `right`: .6 image, .4
    caption."""
    from quire.operators.layout import page_pairs

    pairs = page_pairs(images, media)
    a, b = G.side("a"), G.side("b")
    caption = F.when(F.coalesce("a_caption", F.lit("")) != "", Q.ratio(F.lower(F.trim("a_caption")), F.lower(F.trim(F.coalesce("b_caption", F.lit("")))))).otherwise(F.when(F.coalesce("b_caption", F.lit("")) == "", 1.0).otherwise(0.0))
    best = pairs.withColumn("score", 0.6 * G.image_score(a, b) + 0.4 * caption).groupBy("doc_id", "a_image_id").agg(F.max("score").alias("score"))
    all_ = images.select("doc_id", F.col("image_id").alias("a_image_id")).join(best, ["doc_id", "a_image_id"], "left")
    return all_.groupBy("doc_id").agg(F.count_if(F.coalesce("score", F.lit(0.0)) > right).alias("correct"), F.count("*").alias("total"))


def word_errors(pairs: DataFrame) -> DataFrame:
    """pairs(id, reference, hypothesis): counts of word edits, word and character error rates, and the target by type of document."""
    w, c = Q.edit_counts("reference", "hypothesis", F.lit(True)), Q.edit_counts("reference", "hypothesis", F.lit(False))
    rows = pairs.select("id", w.alias("w"), c.alias("c"))
    rate = lambda s: (F.col(f"{s}.substitutions") + F.col(f"{s}.insertions") + F.col(f"{s}.deletions")) / F.greatest(F.lit(1), F.col(f"{s}.total"))
    return rows.select("id", "w.substitutions", "w.insertions", "w.deletions", rate("w").alias("wer"), rate("c").alias("cer"), (rate("w") <= 0.02).alias("meets_scanned"), (rate("w") <= 0.001).alias("meets_digital"))


def confusions(pairs: DataFrame) -> DataFrame:
    """Counts of differing characters at equal places of words at equal places."""
    zipped = F.arrays_zip(T.words(F.col("reference")).alias("r"), T.words(F.col("hypothesis")).alias("h"))
    rows = pairs.select(F.explode(zipped).alias("z")).select(F.col("z.r").alias("r"), F.col("z.h").alias("h")).filter("r IS NOT NULL AND h IS NOT NULL AND r <> h")
    at = F.explode(F.sequence(F.lit(1), F.least(F.length("r"), F.length("h"))))
    chars = rows.select("r", "h", at.alias("i")).select(F.substring("r", F.col("i"), F.lit(1)).alias("expected"), F.substring("h", F.col("i"), F.lit(1)).alias("read"))
    return chars.filter("expected <> read").groupBy("expected", "read").agg(F.count("*").alias("n"))


def problem_words(pairs: DataFrame, most: int = 20) -> DataFrame:
    """The most frequent pairs of words at equal places that are less than 0.7 alike, or missing on one side (a top-k report)."""
    zipped = F.arrays_zip(T.words(F.col("reference")).alias("r"), T.words(F.col("hypothesis")).alias("h"))
    rows = pairs.select(F.explode(zipped).alias("z")).select("z.r", "z.h").filter("NOT r <=> h")
    counted = rows.groupBy("r", "h").agg(F.count("*").alias("n"))
    alike = counted.withColumn("ratio", Q.ratio("r", "h"))
    odd = alike.filter(F.col("r").isNull() | F.col("h").isNull() | (F.col("ratio") < 0.7))
    return odd.select(F.coalesce("r", F.lit("INSERTED")).alias("expected"), F.coalesce("h", F.lit("DELETED")).alias("read"), "n").orderBy(F.desc("n"), "expected", "read").limit(most)
