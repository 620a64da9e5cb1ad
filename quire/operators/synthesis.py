"""Deterministic synthetic documents: every value follows from a seed and the row's numbers by hashing, never from a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of titles and texts, kinds of pages.
WORDS = ["market", "season", "report", "garden", "signal", "harbor", "paper", "winter", "engine", "letter", "river", "window", "policy", "museum", "camera", "bridge"]
LEVELS = ["simple", "moderate", "complex", "chaotic"]


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that follows from the seed and the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_003)) / 1_000_003.0


def pick(values: list[str], seed: int, *keys: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(draw(seed, *keys) * len(values)) + 1).cast("int"))


def documents(spark: SparkSession, brands: list[str], per_brand: int, seed: int = 1) -> DataFrame:
    """brand, doc_id, level, pages: a suite of documents."""
    rows = spark.range(len(brands) * per_brand).withColumn("brand", F.element_at(F.array(*map(F.lit, brands)), (F.col("id") % len(brands) + 1).cast("int")))
    return rows.select("brand", F.col("id").alias("doc_id"), pick(LEVELS, seed, F.col("id"), F.lit("level")).alias("level"), (F.floor(draw(seed, F.col("id"), F.lit("pages")) * 8) + 2).cast("int").alias("pages"))


def articles(docs: DataFrame, per_page: int = 2, seed: int = 1) -> DataFrame:
    """doc_id, article_id, page, title, text: articles of each page."""
    at = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("pages") * per_page - 1)).alias("article_id"))
    keys = (F.col("doc_id"), F.col("article_id"))
    title = F.initcap(F.concat_ws(" ", *(pick(WORDS, seed, *keys, F.lit(f"t{k}")) for k in range(4))))
    words = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64(F.lit(seed), *keys, i), F.lit(len(WORDS))) + 1).cast("int")))
    return at.select("doc_id", "article_id", F.floor(F.col("article_id") / per_page).cast("int").alias("page"), title.alias("title"), F.concat(F.array_join(words, " "), F.lit(".")).alias("text"))


def layout(arts: DataFrame, seed: int = 1) -> DataFrame:
    """One title and one body block per article in the two columns of its page."""
    side = (F.col("article_id") % 2).cast("double")
    jitter = F.floor(draw(seed, F.col("doc_id"), F.col("article_id"), F.lit("y")) * 20)
    kinds = F.array(F.struct(F.lit("title").alias("type"), F.lit(40.0).alias("top"), F.lit(30.0).alias("height"), F.lit(20.0).alias("font_size"), F.col("title").alias("text")), F.struct(F.lit("body").alias("type"), F.lit(80.0).alias("top"), F.lit(600.0).alias("height"), F.lit(10.0).alias("font_size"), F.col("text").alias("text")))
    rows = arts.select("doc_id", "article_id", "page", side.alias("side"), jitter.alias("jitter"), F.explode(kinds).alias("b"))
    x0, y0 = 40 + 270 * F.col("side"), F.col("b.top") + F.col("jitter")
    return rows.select("doc_id", "article_id", "page", "b.type", x0.alias("x0"), y0.alias("y0"), (x0 + 250).alias("x1"), (y0 + F.col("b.height")).alias("y1"), "b.font_size", "b.text")


def varied(blocks: DataFrame, strength: float = 0.2, seed: int = 1) -> DataFrame:
    """Font sizes up to a share larger or smaller."""
    return blocks.withColumn("font_size", F.col("font_size") * (1 + strength * (2 * draw(seed, F.col("doc_id"), F.col("article_id"), F.col("type")) - 1)))


def element_confidence(overlapping: Column, edge_cases: Column) -> Column:
    """How sure an element can be read: less with overlaps and edge cases, at least .1."""
    return F.greatest(F.lit(0.1), 1 - F.least(F.lit(0.3), 0.1 * overlapping) - F.least(F.lit(0.4), 0.1 * edge_cases))
