"""The corpus pipeline: quality, near duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared folder
and reads them again as the next stage's docs. All stages but the last return the columns of documents.

Rows with a null or repeated doc_id are worked on like others; null and empty texts are scored by the classifier and, if kept,
pass the other stages as they are; of repeated rows one stays; empty tables give an empty result; columns besides doc_id and
text, whatever their names, are passed on up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, near_dedup, privacy, quality
from quire.llm._core import broadcast_if_small, table, written
from quire.llm.queries import surrogate_key, vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a text is scored where it stands, so nothing is shuffled."""
    return quality.accepted(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, the one of the smallest doc_id. Rows are told apart by a written key of their own, so null or
    repeated doc_ids neither drop rows nor keep copies."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = near_dedup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_row"))
    kept = written(found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("first")).select("first._row"))
    return rows.join(broadcast_if_small(kept, 16), "_row", "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates; n_chars follows the text."""
    out = privacy.pseudonymise(docs, surrogate_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and their number."""
    return bpe.encode(docs, vocabulary()).select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", private),
    ("bpe", tokens),
]
#: The classifier, edit distances and the tokenizer have no SQL form; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
