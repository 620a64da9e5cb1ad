"""Registered queries over reports, resolution and synthesis, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import calibration as K
from quire.operators import contributors as C
from quire.operators import layout as L
from quire.operators import reports as R
from quire.operators import resolution as Z
from quire.operators import synthesis as Y
from quire.plans.documents import _candidates, _nodes
from quire.plans.shape import oracle, shaped
from quire.sources import markup as X
from quire.sources import standins as S


def _sure(s, d):
    """Blocks with a confidence by their line."""
    return S.blocks(s, d).withColumn("confidence", (F.col("line_no") * 37 % 100) / 100)


S.SQL["sure"] = "sure AS (SELECT *, (line_no * 37 % 100) / 100 AS confidence FROM blocks)"


def _experiments(s, d):
    return S.table(s, d, "supplier").select(F.col("s_suppkey").alias("experiment_id"), F.col("s_nationkey").alias("brand"), ((F.col("s_acctbal") + 1000) / 11000).alias("accuracy"))


def _ranges(s, d):
    return S.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("article_id")).agg(F.min(F.col("l_partkey") % 40).alias("first_page"), F.min(F.col("l_partkey") % 40 + F.col("l_quantity").cast("long") % 10).alias("last_page"))


def _connections(s, d):
    """Turns of a conversation, each with up to five later ones as candidates."""
    n = _nodes(s, d).select("doc_id", "node", "page")
    a, b = n.select("doc_id", F.col("node").alias("src"), F.col("page").alias("p")), n.select("doc_id", F.col("node").alias("dst"), F.col("page").alias("q"))
    near = a.join(b, "doc_id").filter("dst > src AND dst <= src + 5")
    return near.select("doc_id", "src", "dst", (1 - (F.col("dst") * 7 % 10) / 20).alias("score"), (F.col("q") - F.col("p")).alias("page_gap"), F.when(F.col("dst") == F.col("src") + 1, "follows").otherwise("continues_on").alias("edge_type"))


S.SQL["connections"] = "connections AS (SELECT a.doc_id, a.node AS src, b.node AS dst, 1 - (b.node * 7 % 10) / 20 AS score, b.page - a.page AS page_gap, CASE WHEN b.node = a.node + 1 THEN 'follows' ELSE 'continues_on' END AS edge_type FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND b.node > a.node AND b.node <= a.node + 5)"


def _matches(s, d):
    c = L.match_confidence(_candidates(s, d))
    return c.select("doc_id", "image_id", F.col("line_no").cast("string").alias("caption_id"), "confidence", F.col("proximity").alias("spatial"), F.lit(0.5).alias("semantic"))


def _articles(s, d):
    """Conversations as articles in pairs: the same opening makes a duplicate."""
    rows = S.table(s, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"), F.sort_array(F.collect_set("turn")).alias("nodes"))
    return rows.select(F.floor(F.col("conv_id") / 10).cast("long").alias("doc_id"), F.col("conv_id").alias("article"), "title", "nodes")


QUERIES = {
    "confidence_levels": lambda s, d: shaped(R.confidence_levels(_sure(s, d))),
    "confidence_by_page": lambda s, d: shaped(R.confidence_by(_sure(s, d), F.col("page"), "page")),
    "confidence_by_length": lambda s, d: shaped(R.confidence_by(_sure(s, d), F.octet_length("text"), "length")),
    "confidence_by_region": lambda s, d: shaped(R.confidence_by_region(_sure(s, d))),
    "confidence_patterns": lambda s, d: shaped(R.confidence_patterns(_sure(s, d).withColumnRenamed("line_no", "place"))),
    "page_text_summary": lambda s, d: shaped(R.page_text_summary(S.blocks(s, d))),
    "text_density": lambda s, d: shaped(R.text_density(S.blocks(s, d)).select("doc_id", "page", (F.col("density") * 480_000).alias("covered"))),
    "image_summary": lambda s, d: shaped(R.image_summary(S.images(S.blocks(s, d)))),
    "document_confidence": lambda s, d: shaped(R.document_confidence(L.classify(S.blocks(s, d)).filter(L.rule_class().isNotNull()), 1)),
    "suite_summary": lambda s, d: shaped(R.suite_summary(S.jobs(s, d).select("brand", F.col("priority").alias("articles"), (F.col("job_id") % 9).alias("pages"), (F.col("priority") / 6).alias("difficulty")))),
    "workflow_report": lambda s, d: shaped(R.workflow_report(S.jobs(s, d).select(F.col("brand").alias("annotator"), "status", (F.col("priority") / 5).alias("quality")))),
    "experiment_summary": lambda s, d: shaped(R.experiment_summary(_experiments(s, d))),
    "experiment_comparison": lambda s, d: shaped(R.compared(_experiments(s, d), [1, 2, 3, 5, 8])),
    "key_scores": lambda s, d: shaped(R.key_scores(S.article_evaluations(s, d).select(F.create_map(F.lit("title"), F.col("title"), F.lit("body"), F.col("body")).alias("scores")))),
    "name_statistics": lambda s, d: shaped(R.name_statistics(S.table(s, d, "customer").select(F.concat(F.lit("Dr. Ann "), F.regexp_replace("c_name", "[^A-Za-z]", "")).alias("name")))),
    "invalid_parameters": lambda s, d: R.invalid_parameters(S.table(s, d, "part").select(F.col("p_partkey").alias("key"), F.element_at(F.array(*map(F.lit, ["threshold", "number", "prompt", "rule"])), (F.col("p_partkey") % 4 + 1).cast("int")).alias("kind"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")).alias("value"))),
    "hard_coded_values": lambda s, d: R.hard_coded(S.table(s, d, "events").select(F.col("event_id").alias("path"), F.col("props").alias("json"))),
    "range_overlaps": lambda s, d: Z.range_overlaps(_ranges(s, d)),
    "element_overlaps": lambda s, d: shaped(Z.element_overlaps(S.blocks(s, d).withColumn("x1", F.col("x1") + 60))),
    "resolved_overlaps": lambda s, d: shaped(Z.spread(S.blocks(s, d).withColumn("y1", F.col("y1") + 120))),
    "grouped_bodies": lambda s, d: Z.grouped_bodies(L.classify(S.blocks(s, d)).withColumn("y1", F.col("y1") + 120)),
    "best_connection": lambda s, d: shaped(Z.best_connection(_connections(s, d))),
    "conflict_groups": lambda s, d: Z.conflict_groups(_matches(s, d).select("doc_id", "image_id", F.concat_ws(":", "doc_id", "caption_id").alias("caption_id"))).groupBy("conflict").agg(F.count("*").alias("matches")).groupBy("matches").agg(F.count("*").alias("conflicts")),
    "resolved_captions": lambda s, d: Z.resolve(_matches(s, d)),
    "unique_articles": lambda s, d: Z.unique_articles(_articles(s, d)),
    "pair_quality": lambda s, d: shaped(_matches(s, d).select("image_id", "caption_id", Z.pair_quality(F.col("spatial"), F.col("confidence"), F.lit(2)).alias("quality"))),
    "text_similarity": lambda s, d: shaped((lambda n: n.alias("a").join(n.alias("b"), F.expr("a.doc_id = b.doc_id AND b.node = a.node + 1")).select("a.doc_id", "a.node", Z.semantic_similarity(F.col("a.type"), F.col("a.text"), F.col("b.type"), F.col("b.text")).alias("similarity")))(_nodes(s, d))),
    "readable_blocks": lambda s, d: L.readable(_sure(s, d)).select("doc_id", "line_no"),
    "fallback_classes": lambda s, d: shaped(S.blocks(s, d).select("doc_id", "line_no", L.fallback_class().alias("c")).select("doc_id", "line_no", "c.*")),
    "numbered_images": lambda s, d: L.numbered_images(S.images(S.blocks(s, d))),
    "split_authors": lambda s, d: S.table(s, d, "nation").select("n_nationkey", F.explode(C.split_authors(F.concat(F.lit("By Ann Lee, Tom Fox and Jo "), F.initcap(F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "")))))).alias("author")),
    "xmp_dates": lambda s, d: S.table(s, d, "orders").select("o_orderkey", F.date_format(K.xmp_date(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T07:08:09+02:00"))), "yyyy-MM-dd HH:mm:ss").alias("modified")),
    "body_markup": lambda s, d: S.blocks(s, d).groupBy("doc_id").agg(X.body_xml(F.array_sort(F.collect_list(F.struct("line_no", F.when(F.col("is_bold"), "heading").otherwise("other").alias("type"), "text")))).alias("xml")),
    "synthetic_suite": lambda s, d: shaped(Y.varied(Y.layout(Y.articles(Y.documents(s, ["north", "south", "east"], 40)))).groupBy("type").agg(F.count("*").alias("blocks"), F.avg("font_size").alias("font_size"))),
}

_PAGE_GAP = "CASE WHEN page_gap = 1 THEN 0.15::DOUBLE WHEN page_gap = 0 THEN 0.1::DOUBLE WHEN page_gap > 2 THEN -0.1::DOUBLE ELSE 0 END + CASE edge_type WHEN 'follows' THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END"
ORACLE_SQL = {
    "confidence_by_page": oracle("blocks sure", "SELECT page, avg(confidence) AS confidence, count(*) AS n FROM sure GROUP BY page", "page ~confidence n"),
    "confidence_by_length": oracle("blocks sure", "SELECT CAST(strlen(text) AS INTEGER) AS length, avg(confidence) AS confidence, count(*) AS n FROM sure GROUP BY 1", "length ~confidence n"),
    "confidence_by_region": oracle("blocks sure", 'SELECT CAST(least(2, greatest(0, floor((x0 + x1) / 2 / 600 * 3))) AS INTEGER) AS "column", CAST(least(2, greatest(0, floor((y0 + y1) / 2 / 800 * 3))) AS INTEGER) AS "row", avg(confidence) AS confidence, count(*) AS blocks FROM sure GROUP BY 1, 2', '"column" "row" ~confidence blocks'),
    "confidence_patterns": oracle(
        "blocks sure", "SELECT doc_id, count(*) AS words, CAST(sum(low) AS BIGINT) AS low_words, CAST(sum(CASE WHEN low = 1 AND before = 0 THEN 1 ELSE 0 END) AS BIGINT) AS low_runs, avg(confidence) AS confidence FROM (SELECT *, coalesce(lag(low) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS before FROM (SELECT *, CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END AS low FROM sure)) GROUP BY doc_id", "doc_id words low_words low_runs ~confidence"
    ),
    "page_text_summary": oracle("blocks", "SELECT doc_id, page, count(*) AS blocks, CAST(sum(n_words) AS BIGINT) AS words, CAST(sum(strlen(text)) AS BIGINT) AS bytes, avg(font_size) AS font_size, count(DISTINCT font_size) AS fonts, avg(CAST(is_bold AS INTEGER)) AS bold_share FROM blocks GROUP BY doc_id, page", "doc_id page blocks words bytes ~font_size fonts ~bold_share"),
    "text_density": oracle("blocks", "SELECT doc_id, page, sum((x1 - x0) * (y1 - y0)) AS covered FROM blocks GROUP BY doc_id, page", "doc_id page ~covered"),
    "image_summary": oracle("blocks images", "SELECT doc_id, count(*) AS images, count(DISTINCT page) AS pages, sum((x1 - x0) * (y1 - y0)) AS area, max((x1 - x0) * (y1 - y0)) AS largest FROM images GROUP BY doc_id", "doc_id images pages ~area ~largest"),
    "document_confidence": oracle(
        "blocks ruled",
        "SELECT doc_id, greatest(0.1::DOUBLE, least(1, sum(w * c) / greatest(1, sum(w)) - 0.05::DOUBLE)) AS confidence FROM (SELECT doc_id, CASE type WHEN 'title' THEN 2.0::DOUBLE WHEN 'heading' THEN 1.5::DOUBLE WHEN 'byline' THEN 1.5::DOUBLE WHEN 'caption' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS w, CASE type WHEN 'title' THEN 0.9::DOUBLE WHEN 'page_number' THEN 0.9::DOUBLE WHEN 'caption' THEN 0.7::DOUBLE WHEN 'heading' THEN 0.7::DOUBLE WHEN 'body' THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS c FROM ruled WHERE type IS NOT NULL) GROUP BY doc_id",
        "doc_id ~confidence",
    ),
    "suite_summary": oracle("jobs", "SELECT brand, count(*) AS documents, CAST(sum(priority) AS BIGINT) AS articles, CAST(sum(job_id % 9) AS BIGINT) AS pages, avg(priority / 6) AS difficulty FROM jobs GROUP BY ROLLUP (brand)", "brand documents articles pages ~difficulty"),
    "workflow_report": oracle("jobs", "SELECT brand AS annotator, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, avg(priority / 5) FILTER (WHERE status = 'completed') AS validated_quality FROM jobs GROUP BY brand", "annotator completed pending running ~validated_quality"),
    "experiment_summary": oracle("results", "SELECT count(*) AS experiments, count(DISTINCT s_nationkey) AS brands, avg(CASE WHEN (s_acctbal + 1000) / 11000 >= 0.9::DOUBLE THEN 1 ELSE 0 END) AS ready_share, max((s_acctbal + 1000) / 11000) AS best, arg_max(s_suppkey, s_acctbal) AS best_id FROM supplier", "experiments brands ~ready_share ~best best_id"),
    "experiment_comparison": oracle("results", "SELECT s_suppkey AS experiment_id, s_nationkey AS brand, (s_acctbal + 1000) / 11000 AS accuracy, (max(s_acctbal) OVER () - s_acctbal) / 11000 AS behind FROM supplier WHERE s_suppkey IN (1, 2, 3, 5, 8)", "experiment_id brand ~accuracy ~behind"),
    "key_scores": oracle("article_evaluations", "SELECT 'title' AS key, avg(title) AS score, count(*) AS n FROM article_evaluations UNION ALL SELECT 'body', avg(body), count(*) FROM article_evaluations", "key ~score n"),
    "range_overlaps": (
        "WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS article_id, min(l_partkey % 40) AS f, min(l_partkey % 40 + CAST(l_quantity AS BIGINT) % 10) AS l FROM lineitem GROUP BY 1, 2) SELECT a.doc_id, a.article_id AS a_article_id, b.article_id AS b_article_id FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.article_id < b.article_id AND a.f <= b.l AND b.f <= a.l"
    ),
    "best_connection": oracle(
        "nodes connections",
        f"SELECT doc_id, src, dst, final AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, src ORDER BY final DESC, dst) AS best FROM (SELECT *, score + CASE WHEN max(score) FILTER (WHERE rn = 1) OVER w - coalesce(max(score) FILTER (WHERE rn = 2) OVER w, -1) < 0.1::DOUBLE THEN {_PAGE_GAP} ELSE 0 END AS final FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, src ORDER BY score DESC, dst) AS rn FROM connections) WHERE rn <= 3 WINDOW w AS (PARTITION BY doc_id, src))) WHERE best = 1",
        "doc_id src dst ~score",
    ),
    "element_overlaps": oracle(
        "blocks",
        "SELECT doc_id, page, src, dst, ox * oy / greatest(area_a + area_b - ox * oy, 1e-6::DOUBLE) AS iou FROM (SELECT a.doc_id, a.page, a.line_no AS src, b.line_no AS dst, least(a.x1, b.x1) + 60 - greatest(a.x0, b.x0) AS ox, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS oy, (a.x1 + 60 - a.x0) * (a.y1 - a.y0) AS area_a, (b.x1 + 60 - b.x0) * (b.y1 - b.y0) AS area_b FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.page = b.page AND a.line_no < b.line_no) WHERE ox > 0 AND oy > 0",
        "doc_id page src dst ~iou",
    ),
    "pair_quality": oracle(
        "blocks images candidates",
        "SELECT image_id, CAST(line_no AS VARCHAR) AS caption_id, 0.4::DOUBLE * proximity + 0.4::DOUBLE * ((0.4::DOUBLE * proximity + 0.25::DOUBLE * 0.3::DOUBLE + 0.2::DOUBLE * layout + 0.15::DOUBLE * CASE WHEN competitors = 0 THEN 1.0::DOUBLE WHEN competitors <= 2 THEN 0.8::DOUBLE WHEN competitors <= 5 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) * (1 - 0.3::DOUBLE * least(1, competitors / 10))) + 0.2::DOUBLE * 0.4::DOUBLE AS quality FROM candidates",
        "image_id caption_id ~quality",
    ),
    "hard_coded_values": "SELECT event_id AS path, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
    "invalid_parameters": oracle(
        "results",
        "SELECT key, errors FROM (SELECT key, concat_ws(';', CASE WHEN value IS NULL THEN 'missing' END, CASE WHEN kind IN ('threshold', 'number') AND n IS NULL THEN 'not a number' END, CASE WHEN kind = 'threshold' AND NOT n BETWEEN 0 AND 1 THEN 'outside 0 to 1' END, CASE WHEN kind = 'prompt' AND length(value) < 10 THEN 'prompt too short' END, CASE WHEN kind = 'rule' THEN 'rule without condition' END) AS errors "
        "FROM (SELECT *, try_cast(value AS DOUBLE) AS n FROM (SELECT p_partkey AS key, ['threshold', 'number', 'prompt', 'rule'][CAST(p_partkey % 4 AS INTEGER) + 1] AS kind, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS value FROM part))) WHERE errors <> ''",
        "key errors",
    ),
    "confidence_levels": oracle(
        "blocks sure",
        "SELECT level, CAST(sum(n) AS BIGINT) AS elements, sum(n * c) / sum(n) AS average, min(c) AS least, max(c) AS most, sqrt(greatest(0, sum(n * c * c) / sum(n) - pow(sum(n * c) / sum(n), 2))) AS spread, CAST(sum(CASE WHEN c >= 0.8::DOUBLE THEN n ELSE 0 END) AS BIGINT) AS reliable, CAST(sum(CASE WHEN c < 0.5 THEN n ELSE 0 END) AS BIGINT) AS uncertain FROM ("
        "SELECT 'block' AS level, 1 AS n, confidence AS c FROM sure UNION ALL SELECT 'line', 1, confidence FROM sure UNION ALL SELECT 'word', n_words, confidence FROM sure UNION ALL SELECT 'character', length(text), confidence FROM sure) WHERE n > 0 GROUP BY level",
        "level elements ~average ~least ~most ~spread reliable uncertain",
    ),
    "name_statistics": oracle("results", "SELECT count(*) AS names, count(*) AS complete, 0::BIGINT AS suffixed, count(*) AS prefixed, 0.95::DOUBLE AS confidence FROM customer", "names complete suffixed prefixed ~confidence"),
    "conflict_groups": (
        oracle("blocks images candidates", "SELECT doc_id, image_id, line_no FROM candidates", "doc_id image_id line_no").replace("WITH ", "WITH RECURSIVE ", 1).replace(
            " SELECT doc_id, image_id, line_no FROM result",
            ", hop AS (SELECT DISTINCT a.image_id AS x, b.image_id AS y FROM result a JOIN result b ON a.doc_id = b.doc_id AND a.line_no = b.line_no), reach(x, y) AS (SELECT x, y FROM hop UNION SELECT r.x, h.y FROM reach r JOIN hop h ON h.x = r.y), conflict AS (SELECT x AS image_id, min(y) AS c FROM reach GROUP BY x) "
            "SELECT matches, count(*) AS conflicts FROM (SELECT c, count(*) AS matches FROM result JOIN conflict USING (image_id) GROUP BY c) GROUP BY matches",
        )
    ),
    "readable_blocks": oracle("blocks sure", "SELECT doc_id, line_no FROM sure WHERE confidence >= 0.5 AND length(trim(text)) >= 3 AND regexp_matches(text, '[\\p{L}\\p{N}]')", "doc_id line_no"),
    "fallback_classes": oracle(
        "blocks",
        "SELECT doc_id, line_no, CASE WHEN regexp_matches(lower(trim(text)), '^(?:page\\s*)?\\d+$') THEN 'page_number' WHEN n_words <= 10 AND font_size > 14 THEN 'title' WHEN lower(trim(text)) LIKE 'by %' OR contains(lower(text), 'correspondent') THEN 'byline' WHEN font_size < 10 THEN 'caption' WHEN n_words >= 10 THEN 'body' ELSE 'unknown' END AS type, "
        "CASE type WHEN 'page_number' THEN 0.8::DOUBLE WHEN 'title' THEN 0.7::DOUBLE WHEN 'byline' THEN 0.7::DOUBLE WHEN 'caption' THEN 0.6::DOUBLE WHEN 'body' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM blocks",
        "doc_id line_no type ~confidence",
    ),
    "numbered_images": oracle("blocks images", "SELECT doc_id, image_id, CAST(row_number() OVER w AS INTEGER) AS sequence, 'image_' || lpad(CAST(row_number() OVER w AS VARCHAR), 3, '0') || '.jpg' AS filename FROM images WINDOW w AS (PARTITION BY doc_id ORDER BY page, y0, x0, image_id)", "doc_id image_id sequence filename"),
    "xmp_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 07:08:09' AS modified FROM orders",
    "split_authors": (
        "SELECT n_nationkey, unnest(['Ann Lee', 'Tom Fox'] || CASE WHEN length(letters) < 2 THEN [] ELSE ['Jo ' || upper(substr(letters, 1, 1)) || lower(substr(letters, 2))] END) AS author FROM (SELECT n_nationkey, regexp_replace(n_name, '[^A-Za-z]', '', 'g') AS letters FROM nation)"
    ),
    "body_markup": oracle(
        "blocks",
        "SELECT doc_id, '<body>' || string_agg('<' || tag || '>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;') || '</' || tag || '>', '' ORDER BY line_no) || '</body>' AS xml FROM (SELECT *, CASE WHEN is_bold THEN 'heading' ELSE 'paragraph' END AS tag FROM blocks) GROUP BY doc_id",
        "doc_id xml",
    ),
}
