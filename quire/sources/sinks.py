"""Writers of the engine's tables: ground truth as JSON and XML, layouts as CSV and XML, graphs as JSON; and what reads configurations."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.markup import escaped


def truth_json(articles: DataFrame, path: str) -> None:
    """One JSON line per document with its articles."""
    articles.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in articles.columns if c != "doc_id"]))).alias("articles")).write.mode("overwrite").json(path)


def truth_xml(articles: DataFrame, path: str) -> None:
    articles.write.mode("overwrite").format("xml").option("rootTag", "articles").option("rowTag", "article").save(path)


def layout_csv(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def layout_xml(blocks: DataFrame) -> DataFrame:
    """doc_id, xml: the blocks of a document page by page."""
    attributes = F.concat(*(F.concat(F.lit(f' {c}="'), escaped(F.col(c).cast("string")), F.lit('"')) for c in ("page", "line_no", "x0", "y0", "x1", "y1", "type")))
    block = F.concat(F.lit("<block"), attributes, F.lit(">"), escaped(F.col("text")), F.lit("</block>"))
    ordered = F.array_sort(F.collect_list(F.struct("page", "line_no", block.alias("b"))))
    return blocks.groupBy("doc_id").agg(F.concat(F.lit("<layout>"), F.array_join(F.transform(ordered, lambda x: x["b"]), ""), F.lit("</layout>")).alias("xml"))


@F.pandas_udf(T.StringType())
def _formatted(xml: pd.Series, style: pd.Series) -> pd.Series:
    def one(text: str | None, kind: str) -> str | None:
        if text is None:
            return None
        try:
            root = ElementTree.fromstring(text)
        except ElementTree.ParseError:
            return None
        if kind == "canonical":
            return ElementTree.canonicalize(text)
        if kind == "pretty":
            ElementTree.indent(root)
        elif kind == "compact":
            for x in root.iter():
                x.text, x.tail = (x.text or "").strip() or None, (x.tail or "").strip() or None
        return ElementTree.tostring(root, encoding="unicode")

    return pd.Series([one(x, k) for x, k in zip(xml, style, strict=True)], dtype=object)


def formatted(xml: DataFrame, style: str, column: str = "xml") -> DataFrame:
    """The XML of a column as canonical, pretty or compact text; null where it can't be parsed."""
    return xml.withColumn(column, _formatted(column, F.lit(style)))


def config(spark: SparkSession, path: str) -> DataFrame:
    """key, value: a JSON configuration flattened to dotted keys. A configuration file is small and read on the driver through Spark."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())

    def walk(prefix: str, x: object) -> Iterator[tuple[str, str]]:
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(f"{prefix}.{k}" if prefix else k, v)
        else:
            yield prefix, json.dumps(x, sort_keys=True)

    return spark.createDataFrame(list(walk("", json.loads(text))), "key string, value string")


def training_examples(docs: DataFrame, column: str = "xml") -> DataFrame:
    """doc_id, block, token, label, bbox: the words of labelled blocks of page XML."""
    parsed = docs.select("doc_id", F.from_xml(column, "page array<struct<block: array<struct<_id: string, _type: string, _bbox: string, text: string>>>>").alias("x"))
    rows = parsed.select("doc_id", F.explode("x.page").alias("p")).select("doc_id", F.explode("p.block").alias("b"))
    return rows.select("doc_id", F.col("b._id").alias("block"), F.posexplode(F.split(F.trim("b.text"), r"\s+")).alias("place", "token"), F.col("b._type").alias("label"), F.col("b._bbox").alias("bbox"))
