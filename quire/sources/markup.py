"""Articles from XML and back, graphs from JSON and back, files with hashes; readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The part of an extraction result that an article element holds.
ARTICLE = "_id string, title string, contributors struct<contributor: array<struct<_name: string, _role: string>>>, body struct<paragraph: array<string>>, images struct<image: array<struct<_id: string, _bbox: string, caption: string>>>"
GRAPH = "nodes array<struct<id: string, type: string, page: int, confidence: double>>, edges array<struct<source: string, target: string, type: string, confidence: double>>"


def articles_from_xml(docs: DataFrame, column: str = "xml") -> DataFrame:
    """docs(doc_id, xml) to articles: id, title, text, contributors (attributes first, then the byline, which only the opening
    paragraph can be), images."""
    parsed = docs.select("doc_id", F.from_xml(column, f"article array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _fields(ARTICLE))}>>", {"mode": "PERMISSIVE"}).alias("x"))
    a = parsed.select("doc_id", F.explode_outer("x.article").alias("a")).filter("a IS NOT NULL")
    paragraphs = F.coalesce("a.body.paragraph", F.array())
    named = F.transform(F.coalesce("a.contributors.contributor", F.array()), lambda c: F.struct(c["_name"].alias("name"), F.coalesce(c["_role"], F.lit("author")).alias("role")))
    bylines = F.transform(F.filter(F.slice(paragraphs, 1, 1), lambda p: F.lower(F.trim(p)).startswith("by ")), lambda p: F.struct(F.trim(F.substring(F.trim(p), 4, 200)).alias("name"), F.lit("author").alias("role")))
    boxes = F.transform(F.coalesce("a.images.image", F.array()), lambda i: F.struct(i["_id"].alias("id"), F.transform(F.split(F.coalesce(i["_bbox"], F.lit("0,0,0,0")), ","), lambda v: v.try_cast("double")).alias("bbox"), i["caption"].alias("caption")))
    return a.select("doc_id", F.col("a._id").alias("article_id"), F.col("a.title").alias("title"), F.concat_ws(" ", F.col("a.title"), F.array_join(paragraphs, " ")).alias("text"), F.concat(named, bylines).alias("contributors"), boxes.alias("images"))


def _fields(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:k].strip())
            start = k + 1
    return out


def escaped(text: Column) -> Column:
    """Text with the five characters that XML reserves as references."""
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(ref))
    return text


def article_xml(title: Column, contributors: Column, paragraphs: Column) -> Column:
    """An article element; contributors are (name, role) structs; unknown block types go as paragraphs."""
    people = F.array_join(F.transform(contributors, lambda c: F.concat(F.lit('<contributor name="'), escaped(c["name"]), F.lit('" role="'), escaped(c["role"]), F.lit('"/>'))), "")
    body = F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<paragraph>"), escaped(p), F.lit("</paragraph>"))), "")
    return F.concat(F.lit("<article><title>"), escaped(title), F.lit("</title><contributors>"), people, F.lit("</contributors><body>"), body, F.lit("</body></article>"))


def graph_from_json(docs: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, json) to nodes and edges."""
    g = docs.select("doc_id", F.from_json(column, GRAPH).alias("g"))
    nodes = g.select("doc_id", F.explode("g.nodes").alias("n")).select("doc_id", F.col("n.id").alias("node"), "n.type", "n.page", "n.confidence")
    edges = g.select("doc_id", F.explode("g.edges").alias("e")).select("doc_id", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.type").alias("edge_type"), "e.confidence")
    return nodes, edges


def graph_to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, json: a document's nodes and edges, each in order."""
    n = nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("node").cast("string").alias("id"), "type", "page", "confidence"))).alias("nodes"))
    e = edges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), F.col("edge_type").alias("type"), "confidence"))).alias("edges"))
    return n.join(e, "doc_id", "left").select("doc_id", F.to_json(F.struct("nodes", F.coalesce("edges", F.expr("array()")).alias("edges"))).alias("json"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, kind, size, modified and SHA-256 of files; each content once, the first path of it stays."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = raw.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), kind.alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"))
    return rows.groupBy("hash").agg(F.min(F.struct("path", "name", "kind", "size", "modified")).alias("f")).select("f.*", "hash")


def strict(docs: DataFrame, schema: str, column: str = "xml") -> tuple[DataFrame, DataFrame]:
    """Rows whose XML fits a schema, parsed, and the rows that don't (quarantine)."""
    parsed = docs.withColumn("parsed", F.from_xml(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("parsed").isNull() | F.col("parsed._corrupt").isNotNull()
    return parsed.filter(~bad), parsed.filter(bad).drop("parsed")


def media_xml(images: Column) -> Column:
    """A media element of (id, bbox, caption, confidence, pairing) structs; the confidence falls back to that of the pairing."""
    one = lambda i: F.concat(F.lit('<image id="'), escaped(i["id"]), F.lit('" bbox="'), F.array_join(F.transform(i["bbox"], lambda v: v.cast("string")), ","), F.lit('" confidence="'), F.format_string("%.2f", F.coalesce(i["confidence"], i["pairing"], F.lit(0.0))), F.lit('"><caption>'), escaped(F.coalesce(i["caption"], F.lit(""))), F.lit("</caption></image>"))
    return F.concat(F.lit("<media>"), F.array_join(F.transform(images, one), ""), F.lit("</media>"))


def body_xml(blocks: Column) -> Column:
    """A body element of (type, text) structs; types that have no element of their own become paragraphs."""
    known = ["paragraph", "heading", "quote", "list"]
    tag = lambda b: F.when(b["type"].isin(known), b["type"]).otherwise("paragraph")
    return F.concat(F.lit("<body>"), F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("<"), tag(b), F.lit(">"), escaped(b["text"]), F.lit("</"), tag(b), F.lit(">"))), ""), F.lit("</body>"))
