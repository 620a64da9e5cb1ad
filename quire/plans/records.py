"""Registered queries over contributors, calibration, validation, markup and timelines, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import calibration as K
from quire.operators import contributors as C
from quire.operators import timelines as E
from quire.operators import validation as V
from quire.plans.documents import _nodes
from quire.operators import graphs as G
from quire.plans.shape import oracle, shaped
from quire.sources import markup as X
from quire.sources import standins as S


def _credits(s, d):
    """Sentences with a byline or a credit built from names of nations."""
    n, r = S.table(s, d, "nation"), F.element_at(F.array(*map(F.lit, ["By {0} Smith", "Photo by {0} Jones", "{0} Miller, staff writer", "Courtesy of {0} Brown", "Written by {0} Stone"])), (F.col("n_nationkey") % 5 + 1).cast("int"))
    name = F.initcap(F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "")))
    name = F.when(F.length(name) < 2, F.lit("Ann")).otherwise(name)
    return n.select(F.col("n_nationkey").alias("id"), F.replace(r, F.lit("{0}"), name).alias("text"))


def _spans(s, d):
    return S.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + F.col("l_quantity").cast("int")).alias("stop"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.col("l_linenumber").alias("label"))


def _block_ids(s, d):
    return S.table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 30).alias("block_id"))


def _references(s, d):
    return S.table(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 30).alias("block_id"))


S.SQL["block_ids"] = "block_ids AS (SELECT l_orderkey AS doc_id, l_partkey % 30 AS block_id FROM lineitem), refs AS (SELECT l_orderkey AS doc_id, l_suppkey % 30 AS block_id FROM lineitem WHERE l_returnflag = 'R')"


def _ranges(s, d):
    return S.table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("article_id"), (F.col("l_partkey") % 100).alias("first_page"), (F.col("l_partkey") % 100 + F.col("l_quantity").cast("long") % 10).alias("last_page"))


def _files(s, d):
    kind = F.element_at(F.array(*map(F.lit, ["xml", "metadata", "pdf"])), (F.col("o_orderkey") * 7 % 3 + 1).cast("int"))
    return S.table(s, d, "orders").select((F.col("o_custkey") % 4).cast("int").alias("brand"), kind.alias("kind"), F.concat_ws("_", F.lit("f"), "o_orderkey").alias("name"))


S.SQL["data_files"] = "data_files AS (SELECT CAST(o_custkey % 4 AS INTEGER) AS brand, ['xml', 'metadata', 'pdf'][CAST(o_orderkey * 7 % 3 AS INTEGER) + 1] AS kind, 'f_' || o_orderkey AS name FROM orders)"


def _truths(s, d):
    return S.table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_linenumber") % 7 == 0).cast("int").alias("errors"), (F.col("l_suppkey") % 4).alias("warnings"), (F.col("l_partkey") % 3).alias("contributors"), (F.col("l_partkey") % 2).alias("captions"), (1 - F.col("l_discount")).alias("confidence"))


def _article_docs(s, d):
    """Benchmark passages as XML documents of two articles."""
    paragraphs = F.split("text", r"\. ")
    one = X.article_xml(F.concat(F.lit("Item & "), F.col("item_id").cast("string")), F.array(F.struct(F.lit("Ann O'Neil").alias("name"), F.lit("author").alias("role"))), F.concat(F.array(F.lit("By Tom Fox")), paragraphs))
    two = X.article_xml(F.lit("Second"), F.expr("cast(array() as array<struct<name: string, role: string>>)"), F.array(F.col("text")))
    return S.table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("<result>"), one, two, F.lit("</result>")).alias("xml"))


def _roundtrip(s, d):
    n = _nodes(s, d).select("doc_id", "node", "type", "page", "confidence")
    e = G.follows(n)
    nodes, edges = X.graph_from_json(X.graph_to_json(n, e))
    return shaped(nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.avg("confidence").alias("confidence")).join(edges.groupBy("doc_id").agg(F.count("*").alias("edges")), "doc_id", "left").na.fill(0, ["edges"]))


QUERIES = {
    "byline_matches": lambda s, d: shaped(C.matches(_credits(s, d), C.BYLINES)),
    "credit_matches": lambda s, d: shaped(C.matches(_credits(s, d), C.CREDITS, credit=True)),
    "contributor_roles": lambda s, d: shaped(_credits(s, d).select("id", C.classify_role(F.col("text")).alias("r")).select("id", "r.*")),
    "dedup_contributors": lambda s, d: shaped(C.deduplicate_names(C.best_matches(C.matches(_credits(s, d), C.BYLINES)).select("id", "name", "confidence"))),
    "extraction_quality": lambda s, d: shaped(C.quality_label(_spans(s, d).select((F.col("id") % 100).alias("id"), "confidence"))),
    "span_dedup": lambda s, d: shaped(C.deduplicate_spans(_spans(s, d))),
    "calibration": lambda s, d: shaped(
        S.document_evaluations(s, d).select("event_id", F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("accuracy"))).alias("a")).select("event_id", K.temperature_scaled(F.col("a"), 1.5).alias("temperature"), K.platt_scaled(F.col("a"), 1.2, -0.1).alias("platt"), K.adjusted(F.col("a"), F.lit(1.1), F.lit(-0.05)).alias("adjusted"))
    ),
    "uncertain_votes": lambda s, d: S.table(s, d, "labels").select("doc_id", K.is_uncertain(0.5 + (F.col("doc_id") % 5) / 10, 0.6 + (F.col("doc_id") % 4) / 10).alias("uncertain")),
    "document_types": lambda s, d: S.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), F.avg(F.col("l_quantity") / 50).alias("c")).select("doc_id", K.document_type(F.round(10 * F.col("a"), 4), F.round(12 * F.col("b"), 4), F.round("c", 4), F.lit(0.5)).alias("type")),
    "quality_levels": lambda s, d: _truths(s, d).select("id", K.quality_level(F.col("captions") == 1, F.col("confidence"), F.col("warnings")).alias("level")),
    "pdf_dates": lambda s, d: S.table(s, d, "orders").select("o_orderkey", F.date_format(K.pdf_date(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("1305+02'00'"))), "yyyy-MM-dd HH:mm:ss").alias("created")),
    "data_integrity": lambda s, d: shaped(V.integrity(_block_ids(s, d), _references(s, d))),
    "content_quality": lambda s, d: shaped(V.content_quality(S.blocks(s, d))),
    "page_overlap": lambda s, d: V.page_overlaps(_ranges(s, d)),
    "dataset_coverage": lambda s, d: shaped(V.coverage(_files(s, d))),
    "truth_scores": lambda s, d: shaped(V.truth_score(_truths(s, d))),
    "check_scores": lambda s, d: shaped(V.check_scores(S.document_evaluations(s, d).select(F.col("metric").alias("check"), F.col("accuracy").alias("score")))),
    "dataset_manifest": lambda s, d: V.manifest(_files(s, d)),
    "complexity_counts": lambda s, d: V.complexity_counts(s, 1003, {"simple": 0.3, "moderate": 0.4, "complex": 0.2, "chaotic": 0.1}),
    "xml_articles": lambda s, d: X.articles_from_xml(_article_docs(s, d)).select("doc_id", "title", "text", F.size("contributors").alias("contributors"), F.array_join(F.transform("contributors", lambda c: c["name"]), ";").alias("names")),
    "graph_json": lambda s, d: _roundtrip(s, d),
    "event_windows": lambda s, d: shaped(E.tumbling(S.table(s, d, "events"), 3600)),
    "event_rates": lambda s, d: shaped(E.rates(S.table(s, d, "events"))),
    "sessions": lambda s, d: E.sessions(S.table(s, d, "events"), 1800),
    "held_alerts": lambda s, d: shaped(E.held_alerts(S.table(s, d, "events"), "error", 3600, 0.2, 2)),
    "bucket_percentile": lambda s, d: shaped(E.bucket_percentile(S.table(s, d, "events"), 0.95)),
}

_A = "least(0.999::DOUBLE, greatest(0.001::DOUBLE, accuracy))"
_LOGIT = f"ln({_A} / (1 - {_A} + 1e-8::DOUBLE))"
S.SQL["truths"] = "truths AS (SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_linenumber % 7 = 0 AS INTEGER) AS errors, l_suppkey % 4 AS warnings, l_partkey % 3 AS contributors, l_partkey % 2 AS captions, 1 - l_discount AS confidence FROM lineitem)"
_AT = "CAST(floor(epoch(ts)) AS BIGINT)"

ORACLE_SQL = {
    "extraction_quality": oracle(
        "results",
        "SELECT l_orderkey % 100 AS id, avg(c) AS mean, avg(CASE WHEN c >= 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share, CASE WHEN avg(c) >= 0.9::DOUBLE AND avg(CASE WHEN c >= 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.8::DOUBLE THEN 'high' WHEN avg(c) >= 0.7::DOUBLE AND avg(CASE WHEN c >= 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS quality FROM (SELECT l_orderkey, round(1 - l_discount, 2) AS c FROM lineitem) GROUP BY 1",
        "id ~mean ~share quality",
    ),
    "calibration": oracle("document_evaluations", f"SELECT event_id, 1 / (1 + exp(-{_LOGIT} / 1.5)) AS temperature, 1 / (1 + exp(-(1.2::DOUBLE * {_LOGIT} - 0.1::DOUBLE))) AS platt, least(1, greatest(0, {_A} * 1.1::DOUBLE - 0.05::DOUBLE)) AS adjusted FROM document_evaluations", "event_id ~temperature ~platt ~adjusted"),
    "uncertain_votes": "SELECT doc_id, 0.5::DOUBLE + (doc_id % 5) / 10 < 0.6::DOUBLE OR 0.6::DOUBLE + (doc_id % 4) / 10 < 0.7::DOUBLE OR (0.5::DOUBLE + (doc_id % 5) / 10 < 0.8::DOUBLE AND 0.6::DOUBLE + (doc_id % 4) / 10 < 0.8::DOUBLE) AS uncertain FROM labels",
    "quality_levels": oracle("truths", "SELECT id, CASE WHEN captions = 1 AND warnings = 0 THEN 'gold' WHEN confidence >= 0.95::DOUBLE AND warnings <= 2 THEN 'silver' WHEN confidence >= 0.8::DOUBLE THEN 'bronze' ELSE 'rejected' END AS level FROM truths", "id level"),
    "pdf_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 13:05:00' AS created FROM orders",
    "data_integrity": oracle(
        "block_ids",
        "SELECT b.doc_id, blocks, duplicates, coalesce(dangling, 0) AS dangling, coalesce(unreferenced, 0) AS unreferenced, greatest(0, 1 - 0.05::DOUBLE * (duplicates + coalesce(dangling, 0))) AS score, duplicates + coalesce(dangling, 0) = 0 AS passed FROM (SELECT doc_id, count(DISTINCT block_id) AS blocks, count(*) - count(DISTINCT block_id) AS duplicates FROM block_ids GROUP BY doc_id) b "
        "LEFT JOIN (SELECT doc_id, count(*) AS dangling FROM refs r WHERE NOT EXISTS (SELECT 1 FROM block_ids b WHERE b.doc_id = r.doc_id AND b.block_id = r.block_id) GROUP BY doc_id) d USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS unreferenced FROM (SELECT DISTINCT * FROM block_ids) b WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE b.doc_id = r.doc_id AND b.block_id = r.block_id) GROUP BY doc_id) u USING (doc_id)",
        "doc_id blocks duplicates dangling unreferenced ~score passed",
    ),
    "content_quality": oracle(
        "blocks",
        "SELECT doc_id, blocks, empty, short, bad_boxes, greatest(0, 1 - (empty + bad_boxes) / greatest(1, 3 * blocks)::DOUBLE) AS score FROM (SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE trim(text) = '') AS empty, count(*) FILTER (WHERE trim(text) <> '' AND length(trim(text)) < 3) AS short, count(*) FILTER (WHERE x1 <= x0 OR y1 <= y0) AS bad_boxes FROM blocks GROUP BY doc_id)",
        "doc_id blocks empty short bad_boxes ~score",
    ),
    "page_overlap": "SELECT doc_id, article_id, next_id FROM (SELECT *, lead(first_page) OVER w AS next_first, lead(article_id) OVER w AS next_id FROM (SELECT l_orderkey AS doc_id, l_linenumber AS article_id, l_partkey % 100 AS first_page, l_partkey % 100 + CAST(l_quantity AS BIGINT) % 10 AS last_page FROM lineitem) WINDOW w AS (PARTITION BY doc_id ORDER BY first_page, article_id, last_page)) WHERE last_page >= next_first",
    "dataset_coverage": oracle("data_files", "SELECT brand, xml, metadata, pdf, least(xml, metadata, pdf) AS triplets, least(xml, metadata, pdf) / greatest(1, xml, metadata, pdf)::DOUBLE AS completeness FROM (SELECT brand, count(*) FILTER (WHERE kind = 'xml') AS xml, count(*) FILTER (WHERE kind = 'metadata') AS metadata, count(*) FILTER (WHERE kind = 'pdf') AS pdf FROM data_files GROUP BY brand)", "brand xml metadata pdf triplets ~completeness"),
    "truth_scores": oracle("truths", "SELECT id, CASE WHEN errors > 0 THEN 0 ELSE least(1, greatest(0, (1 - 0.05::DOUBLE * warnings + CASE WHEN contributors > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN captions > 0 THEN 0.1::DOUBLE ELSE 0 END) * confidence)) END AS score FROM truths", "id ~score"),
    "check_scores": oracle("document_evaluations", 'SELECT metric AS "check", avg(accuracy) AS score, avg(avg(accuracy)) OVER () AS overall FROM document_evaluations GROUP BY metric', '"check" ~score ~overall'),
    "dataset_manifest": oracle("data_files", "SELECT kind, count(*) AS files, '[' || string_agg('\"' || name || '\"', ',' ORDER BY name) || ']' AS names FROM data_files GROUP BY kind", "kind files names"),
    "complexity_counts": "SELECT level, CAST(documents AS INTEGER) AS documents FROM (VALUES ('simple', 301), ('moderate', 402), ('complex', 200), ('chaotic', 100)) t(level, documents)",
    "xml_articles": (
        "SELECT item_id AS doc_id, 'Item & ' || item_id AS title, 'Item & ' || item_id || ' By Tom Fox ' || replace(text, '. ', ' ') AS text, 2 AS contributors, 'Ann O''Neil;Tom Fox' AS names FROM benchmark UNION ALL SELECT item_id, 'Second', 'Second ' || text, CAST(lower(trim(text)) LIKE 'by %' AS INTEGER), CASE WHEN lower(trim(text)) LIKE 'by %' THEN trim(substr(trim(text), 4, 200)) ELSE '' END FROM benchmark"
    ),
    "graph_json": oracle("nodes", "SELECT doc_id, count(*) AS nodes, avg(confidence) AS confidence, coalesce(min(n), 0) AS edges FROM nodes LEFT JOIN (SELECT doc_id, count(*) AS n FROM edges GROUP BY doc_id) e USING (doc_id) GROUP BY doc_id", "doc_id nodes ~confidence edges"),
    "event_windows": oracle("results", f"SELECT event_type, {_AT} // 3600 * 3600 AS window_start, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", "event_type window_start n ~total"),
    "event_rates": oracle("results", f"SELECT event_type, {_AT} // 300 * 300 AS window_start, count(*) / 300 AS rate FROM events GROUP BY 1, 2", "event_type window_start ~rate"),
    "sessions": (
        f"WITH r AS (SELECT user_id, event_id, {_AT} AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER w > 1800 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS start FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), "
        "n AS (SELECT *, CAST(sum(start) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS session FROM m) SELECT user_id, session, min(t) AS first_at, max(t) AS last_at, count(*) AS events FROM n GROUP BY user_id, session"
    ),
    "held_alerts": oracle(
        "results",
        f"SELECT min(w) AS first_window, count(*) AS windows, avg(share) AS share FROM (SELECT w, share, w - row_number() OVER (ORDER BY w) AS island FROM (SELECT {_AT} // 3600 AS w, count(*) FILTER (WHERE event_type = 'error') / count(*) AS share FROM events GROUP BY 1) WHERE share >= 0.2::DOUBLE) GROUP BY island HAVING count(*) >= 2",
        "first_window windows ~share",
    ),
    "bucket_percentile": oracle(
        "results",
        "SELECT event_type, (b + (0.95::DOUBLE * total - (upto - n)) / n) * 50 AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY b) AS rn FROM (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM (SELECT event_type, floor(value / 50) AS b, count(*) AS n FROM events GROUP BY 1, 2)) WHERE upto >= 0.95::DOUBLE * total) WHERE rn = 1",
        "event_type ~value",
    ),
    "document_types": oracle(
        "results",
        "SELECT doc_id, CASE WHEN score >= 0.7::DOUBLE THEN 'born_digital' WHEN score <= 0.3::DOUBLE THEN 'scanned' WHEN score BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE THEN 'hybrid' ELSE 'unknown' END AS type FROM (SELECT l_orderkey AS doc_id, 0.3::DOUBLE * round(10 * avg(l_discount), 4) + 0.25::DOUBLE * round(12 * avg(l_tax), 4) + 0.2::DOUBLE * (1 - round(avg(l_quantity / 50), 4)) + 0.125::DOUBLE AS score FROM lineitem GROUP BY l_orderkey)",
        "doc_id type",
    ),
}
