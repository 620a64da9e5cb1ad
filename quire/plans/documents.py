"""Registered queries over pages, text, graphs, parameters and jobs, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import graphs as G
from quire.operators import jobs as J
from quire.operators import layout as L
from quire.operators import matching as M
from quire.operators import parameters as P
from quire.plans.shape import oracle, shaped
from quire.sources import standins as S

AS_OF, BRAND = "1996-06-01 00:00:00", 1


def _classified(s, d):
    return L.classify(S.blocks(s, d))


def _nodes(s, d):
    """Turns of conversations as nodes: eight to a page, type by role and place."""
    rows = S.table(s, d, "conversations")
    return rows.groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").alias("node")).agg(F.min("role").alias("role"), F.min("text").alias("text")).select(
        "doc_id", "node", F.floor(F.col("node") / 8).cast("int").alias("page"), F.when(F.col("node") % 8 == 0, "title").when(F.col("role") == "system", "header").otherwise("body").alias("type"),
        (1 - (F.col("node") % 5) / 10).alias("confidence"), (1 - (F.col("node") % 8) / 8).alias("start_score"), F.size(T.words(F.col("text"))).alias("n_words"), "text",
    )


S.SQL["nodes"] = (
    "nodes AS (SELECT conv_id AS doc_id, turn AS node, CAST(turn // 8 AS INTEGER) AS page, CASE WHEN turn % 8 = 0 THEN 'title' WHEN min(role) = 'system' THEN 'header' ELSE 'body' END AS type, 1 - (turn % 5) / 10 AS confidence FROM conversations GROUP BY conv_id, turn), "
    "edges AS (SELECT * FROM (SELECT doc_id, node AS src, lead(node) OVER (PARTITION BY doc_id, page ORDER BY node) AS dst, 0.8::DOUBLE AS confidence FROM nodes) WHERE dst IS NOT NULL)"
)
_RULES = (
    "CASE WHEN font_size >= 18 AND y0 <= 200 AND n_words <= 20 AND is_bold THEN 'title' WHEN n_words <= 3 AND regexp_matches(text, '^\\d+$|^page\\s+\\d+|^\\d+\\s*/\\s*\\d+$', 'i') THEN 'page_number' WHEN y0 <= 50 AND n_words <= 15 THEN 'header' WHEN y1 >= 750 AND n_words <= 15 THEN 'footer' "
    "WHEN n_words <= 10 AND regexp_matches(text, '^by\\s+|^\\w+\\s+\\w+\\s+reports?|^author:', 'i') THEN 'byline' WHEN font_size <= 10 AND n_words <= 50 THEN 'caption' WHEN font_size >= 14 AND n_words <= 15 THEN 'heading' WHEN n_words >= 5 THEN 'body' END"
)
S.SQL["ruled"] = f"ruled AS (SELECT *, {_RULES} AS type FROM blocks)"
S.SQL["pairs"] = (
    "pairs AS (SELECT a.doc_id, a.page, a.line_no AS src, b.line_no AS dst, greatest(0, b.x0 - a.x1, a.x0 - b.x1) AS h, greatest(0, b.y0 - a.y1, a.y0 - b.y1) AS v, a.y1 < b.y0 AS above, b.y1 < a.y0 AS below, a.x1 < b.x0 AS lft, b.x1 < a.x0 AS rgt FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.page = b.page AND a.line_no < b.line_no), "
    "scored AS (SELECT *, least(1, greatest(0, 0.8::DOUBLE * greatest(0, 1 - (h + v) / 100) * (0.7::DOUBLE + 0.3::DOUBLE * greatest(0, 1 - h / 10)))) AS stacked, least(1, greatest(0, 0.8::DOUBLE * greatest(0, 1 - (h + v) / 100) * (0.7::DOUBLE + 0.3::DOUBLE * greatest(0, 1 - v / 10)))) AS level FROM pairs), "
    "relations AS (SELECT doc_id, page, src, dst, 'above' AS relation, stacked AS confidence FROM scored WHERE h <= 50 AND above UNION ALL SELECT doc_id, page, src, dst, 'below', stacked FROM scored WHERE h <= 50 AND below AND NOT above UNION ALL SELECT doc_id, page, src, dst, 'left_of', level FROM scored WHERE v <= 50 AND lft UNION ALL SELECT doc_id, page, src, dst, 'right_of', level FROM scored WHERE v <= 50 AND rgt AND NOT lft)"
)
_T = "trim(text)"
_N = "len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''))"
_IS_NUMBER = f"regexp_matches({_T}, '^\\d+$') OR regexp_matches({_T}, '^page\\s+\\d+$', 'i') OR regexp_matches({_T}, '^\\d+\\s*/\\s*\\d+$') OR (regexp_matches({_T}, '^[ivxlcdm]+$', 'i') AND length({_T}) <= 6)"
_IS_CONTENT = f"({_N} > 20 OR regexp_matches(lower({_T}), '\\b(article|story|report|analysis|interview)\\b|\\b(said|according to|reported|stated)\\b|\\b(however|therefore|furthermore|moreover)\\b'))"
_IS_BYLINE = f"regexp_matches(lower({_T}), '^by\\s+[a-z]+(?:\\s+[a-z]+)*$') OR regexp_matches(lower({_T}), '\\b(?:reports?|correspondent|editor)\\b') OR regexp_matches(lower({_T}), '^author:\\s*[a-z]+') OR regexp_matches({_T}, '^[A-Z][a-z]+\\s+[A-Z][a-z]+,?\\s+(?:reports?|correspondent)')"
_IS_CAPTION = f"font_size < 10 OR ({_N} <= 30 AND regexp_matches({_T}, '^(?:photo|image|figure|chart):|(?:photo|courtesy|credit):\\s*', 'i'))"
_IS_QUOTE = f"({_T} LIKE '\"%' AND {_T} LIKE '%\"') OR (starts_with({_T}, chr(39)) AND ends_with({_T}, chr(39))) OR ({_N} <= 50 AND contains({_T}, '\"'))"
_IS_AD = " OR ".join(f"contains(lower(text), '{w}')" for w in T.ADS)
_GUESS = (
    f"CASE WHEN {_IS_NUMBER} THEN 'page_number' WHEN y0 < 50 AND NOT {_IS_CONTENT} THEN 'header' WHEN y1 > 750 AND NOT {_IS_CONTENT} THEN 'footer' WHEN y0 < 240 AND font_size > 16 AND n_words <= 15 THEN 'title' WHEN {_IS_BYLINE} THEN 'byline' WHEN {_IS_CAPTION} THEN 'caption' WHEN {_IS_QUOTE} THEN 'quote' WHEN {_IS_AD} THEN 'advertisement' "
    "WHEN font_size > 12 AND n_words <= 20 THEN 'heading' WHEN n_words >= 10 THEN 'body' ELSE 'unknown' END"
)
_GUESS_SURE = "CASE type WHEN 'page_number' THEN 0.8::DOUBLE WHEN 'header' THEN 0.7::DOUBLE WHEN 'footer' THEN 0.7::DOUBLE WHEN 'byline' THEN 0.7::DOUBLE WHEN 'advertisement' THEN 0.7::DOUBLE WHEN 'heading' THEN 0.5::DOUBLE WHEN 'body' THEN 0.4::DOUBLE WHEN 'unknown' THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END"
_RULE_SURE = "CASE type WHEN 'title' THEN 0.9::DOUBLE WHEN 'page_number' THEN 0.9::DOUBLE WHEN 'caption' THEN 0.7::DOUBLE WHEN 'heading' THEN 0.7::DOUBLE WHEN 'body' THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END"
S.SQL["guessed"] = f"guessed AS (SELECT *, {_GUESS_SURE} AS confidence FROM (SELECT *, {_GUESS} AS type FROM blocks))"
_W, _H = "least(i.x1 - i.x0, b.x1 - b.x0)", "least(i.y1 - i.y0, b.y1 - b.y0)"
_OX, _OY = "(least(i.x1, b.x1) - greatest(i.x0, b.x0))", "(least(i.y1, b.y1) - greatest(i.y0, b.y0))"
_ICX, _ICY, _BCX, _BCY = "((i.x0 + i.x1) / 2)", "((i.y0 + i.y1) / 2)", "((b.x0 + b.x1) / 2)", "((b.y0 + b.y1) / 2)"
_DIST = f"sqrt(({_ICX} - {_BCX}) * ({_ICX} - {_BCX}) + ({_ICY} - {_BCY}) * ({_ICY} - {_BCY}))"
_GAP = "sqrt(pow(greatest(0, b.x0 - i.x1, i.x0 - b.x1), 2) + pow(greatest(0, b.y0 - i.y1, i.y0 - b.y1), 2))"
_KIND = (
    f"CASE WHEN {_OX} > 0 AND {_OY} > 0 THEN 'embedded' WHEN b.y0 BETWEEN i.y1 - 0.5 * {_H} AND i.y1 + {_H} AND {_OX} >= 0.3::DOUBLE * {_W} THEN 'direct_below' WHEN b.y1 BETWEEN i.y0 - {_H} AND i.y0 + 0.5 * {_H} AND {_OX} >= 0.3::DOUBLE * {_W} THEN 'direct_above' "
    f"WHEN (b.x0 BETWEEN i.x1 - 0.5 * {_W} AND i.x1 + {_W} OR b.x1 BETWEEN i.x0 - {_W} AND i.x0 + 0.5 * {_W}) AND {_OY} >= 0.3::DOUBLE * {_H} THEN 'side_by_side' WHEN {_GAP} <= 100 THEN 'grouped' ELSE 'distant' END"
)
_ALIGN = f"(0.7::DOUBLE * greatest(0, {_OX} / greatest(i.x1 - i.x0, b.x1 - b.x0)) + 0.3::DOUBLE * greatest(0, {_OY} / greatest(i.y1 - i.y0, b.y1 - b.y0)))"
_POS = f"greatest(0, least(1, 0.5::DOUBLE + CASE WHEN {_BCY} > {_ICY} THEN 0.3::DOUBLE ELSE -0.1::DOUBLE END + CASE WHEN abs({_BCY} - {_ICY}) <= 50 THEN 0.2::DOUBLE * (1 - abs({_BCY} - {_ICY}) / 50) ELSE 0 END))"
_READ = f"greatest(0, least(1, 0.5::DOUBLE + CASE WHEN {_BCY} >= {_ICY} THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN {_BCX} >= {_ICX} THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN {_BCY} < {_ICY} AND {_BCX} < {_ICX} THEN 0.2::DOUBLE ELSE 0 END))"
_CONTAIN = f"CASE WHEN {_OX} > 0 AND {_OY} > 0 THEN 0.8::DOUBLE * {_OX} * {_OY} / ((b.x1 - b.x0) * (b.y1 - b.y0)) ELSE 0 END"
S.SQL["candidates"] = (
    f"near AS (SELECT i.doc_id, i.image_id, b.line_no, {_DIST} AS distance, 0.3::DOUBLE * greatest(0, 1 - {_DIST} / 1000) + 0.2::DOUBLE * {_ALIGN} + 0.2::DOUBLE * {_POS} + 0.15::DOUBLE * {_READ} + 0.05::DOUBLE + 0.05::DOUBLE * {_CONTAIN} AS proximity, {_KIND} AS match_type "
    f"FROM images i JOIN blocks b ON i.doc_id = b.doc_id AND i.page = b.page WHERE b.n_words BETWEEN 2 AND 100 AND {_DIST} <= 500), "
    "candidates AS (SELECT *, CASE match_type WHEN 'direct_below' THEN 0.9::DOUBLE WHEN 'direct_above' THEN 0.8::DOUBLE WHEN 'side_by_side' THEN 0.7::DOUBLE WHEN 'grouped' THEN 0.6::DOUBLE WHEN 'embedded' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS layout, CAST(row_number() OVER (PARTITION BY image_id ORDER BY distance, line_no) AS INTEGER) AS rank, count(*) OVER (PARTITION BY image_id) - 1 AS competitors FROM near)"
)


def _candidates(s, d):
    b = S.blocks(s, d)
    return L.caption_candidates(S.images(b), b)


def _wer_pairs(s, d):
    """Benchmark passages and a copy with every seventh word dropped and every fifth spoilt."""
    w = F.split("text", " ")
    spoilt = F.transform(w, lambda x, i: F.when(i % 7 == 6, "").when(i % 5 == 4, F.concat(x, F.lit("x"))).otherwise(x))
    return S.table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("reference"), F.array_join(F.filter(spoilt, lambda x: x != ""), " ").alias("hypothesis"))


def _steps(s, d):
    """The first stages of each job by its number; the last one failed, runs or is done by its status."""
    order = F.array(*map(F.lit, ["ingestion", "preprocessing", "layout_analysis", "ocr", "article_reconstruction", "image_extraction", "contributor_parsing"]))
    jobs = S.jobs(s, d).withColumn("n", (F.col("job_id") % 7 + 1).cast("int"))
    steps = jobs.select("job_id", "status", "n", F.posexplode(F.slice(order, 1, F.col("n"))).alias("i", "stage"))
    state = F.when(F.col("i") + 1 < F.col("n"), "completed").when(F.col("status") == "completed", "completed").when(F.col("status") == "running", "in_progress").otherwise("failed")
    return steps.select("job_id", "stage", state.alias("status"), (F.col("job_id") % 5).cast("int").alias("attempts"))


S.SQL["steps"] = (
    "names(i, stage) AS (VALUES (0, 'ingestion'), (1, 'preprocessing'), (2, 'layout_analysis'), (3, 'ocr'), (4, 'article_reconstruction'), (5, 'image_extraction'), (6, 'contributor_parsing')), "
    "steps AS (SELECT job_id, stage, CASE WHEN i + 1 < job_id % 7 + 1 THEN 'completed' WHEN status = 'completed' THEN 'completed' WHEN status = 'running' THEN 'in_progress' ELSE 'failed' END AS status, CAST(job_id % 5 AS INTEGER) AS attempts FROM jobs JOIN names ON i < job_id % 7 + 1), "
    "needs(stage, needs) AS (VALUES " + ", ".join(f"('{s}', '{n}')" for s, ns in J.STAGES.items() for n in ns) + ")"
)
def _file():
    return F.concat(F.element_at(F.array(*map(F.lit, ["economist", "time", "vogue", "misc", "wired"])), (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit("_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".pdf"))


S.SQL["files"] = "files AS (SELECT o_orderkey AS job_id, ['economist', 'time', 'vogue', 'misc', 'wired'][CAST(o_orderkey % 5 AS INTEGER) + 1] || '_' || strftime(o_orderdate, '%Y-%m-%d') || '.pdf' AS name FROM orders)"


def _title():
    return F.concat(F.lit("Dr. "), "c_name", F.lit(" &  Prof Co. "), "c_mktsegment")


QUERIES = {
    "block_classify": lambda s, d: L.classify(S.blocks(s, d)).filter(L.rule_class().isNotNull()).select("doc_id", "line_no", "type"),
    "block_heuristics": lambda s, d: shaped(S.blocks(s, d).select("doc_id", "line_no", L.heuristic_class().alias("c")).select("doc_id", "line_no", "c.type", "c.confidence")),
    "block_class_counts": lambda s, d: shaped(_classified(s, d).groupBy("type").agg(F.count("*").alias("blocks"), F.avg("confidence").alias("confidence"))),
    "block_simple_class": lambda s, d: S.blocks(s, d).select("doc_id", "line_no", L.simple_class().alias("type"), L.type_by_font(F.col("font_size"), F.col("is_bold")).alias("text_type")),
    "single_title": lambda s, d: shaped(L.one_title(L.classify(S.blocks(s, d)).filter(L.rule_class().isNotNull())).select("doc_id", "line_no", "type", "confidence")),
    "reading_order": lambda s, d: L.reading_order(S.blocks(s, d)).select("doc_id", "page", "line_no", "reading_order"),
    "block_columns": lambda s, d: L.columns(S.blocks(s, d)).select("doc_id", "page", "line_no", "column"),
    "spatial_edges": lambda s, d: shaped(L.spatial_edges(S.blocks(s, d))),
    "pruned_edges": lambda s, d: L.spatial_edges(S.blocks(s, d)).filter("confidence >= 0.3").groupBy("relation").agg(F.count("*").alias("edges")),
    "merged_blocks": lambda s, d: L.merge_nearby(S.blocks(s, d)),
    "caption_candidates": lambda s, d: shaped(_candidates(s, d).select("image_id", "line_no", "distance", "proximity", "match_type", "layout", "rank", "competitors")),
    "best_caption": lambda s, d: shaped(L.best_caption(_candidates(s, d))),
    "match_confidence": lambda s, d: shaped(L.match_confidence(_candidates(s, d)).select("image_id", "line_no", "confidence")),
    "greedy_assign": lambda s, d: shaped(L.greedy_pairs(L.match_confidence(_candidates(s, d)))),
    "title_normalize": lambda s, d: S.table(s, d, "customer").select("c_custkey", T.normalised_title(_title()).alias("title")),
    "title_case_ratio": lambda s, d: shaped(S.blocks(s, d).filter("n_words BETWEEN 3 AND 20").select("doc_id", "line_no", T.title_case_ratio(F.col("text")).alias("share"))),
    "continuation_markers": lambda s, d: shaped(S.table(s, d, "part").select("p_partkey", F.explode(T.continuation_markers(F.concat("p_name", F.lit(" Continued on page "), F.col("p_size").cast("string"), F.lit(" (cont.) see page 4")))).alias("m")).select("p_partkey", "m.*")),
    "caption_keywords": lambda s, d: shaped(S.table(s, d, "part").select("p_partkey", F.concat(F.lit("Photo by "), "p_type", F.lit(": "), "p_name").alias("t")).select("p_partkey", F.array_join(T.caption_keywords(F.col("t")), ",").alias("keywords"), T.semantic_confidence(T.caption_keywords(F.col("t")), F.col("t")).alias("confidence"))),
    "brand_from_name": lambda s, d: S.table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), T.brand(_file()).alias("brand"), T.issue_date(_file()).alias("issue_date")),
    "name_parse": lambda s, d: shaped(S.table(s, d, "supplier").select("s_suppkey", T.person_name(F.concat(F.lit("Dr. Ana Maria "), F.regexp_replace("s_name", "#", " "), F.lit(", Jr."))).alias("n")).select("s_suppkey", "n.*")),
    "graph_stats": lambda s, d: shaped((lambda n: G.statistics(n, G.follows(n)))(_nodes(s, d))),
    "singletons": lambda s, d: (lambda n: n.join(G.follows(n).select("doc_id", F.col("src").alias("node")).union(G.follows(n).select("doc_id", "dst")), ["doc_id", "node"], "left_anti").select("doc_id", "node"))(_nodes(s, d)),
    "graph_neighbours": lambda s, d: (lambda n: G.neighbours(G.follows(n), n).select("doc_id", "node", "other", "type"))(_nodes(s, d)),
    "dangling_refs": lambda s, d: (lambda n: G.dangling(G.follows(n).withColumn("dst", F.col("dst") + F.when(F.col("src") % 3 == 0, 100).otherwise(0)), n).select("doc_id", "src", "dst"))(_nodes(s, d)),
    "components": lambda s, d: G.components(S.table(s, d, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") - F.col("s_suppkey") % 7 - F.col("s_nationkey") % 2 * 7).alias("dst"))),
    "topological_order": lambda s, d: (lambda n: G.topological_order(n, G.follows(n)))(_nodes(s, d)),
    "article_traversal": lambda s, d: (lambda n: G.reconstruct(n, G.follows(n)))(_nodes(s, d)),
    "article_scores": lambda s, d: (lambda n: shaped(G.article_scores(G.reconstruct(n, G.follows(n)).join(n.select("doc_id", "node", "type", "confidence", "n_words"), ["doc_id", "node"]))))(_nodes(s, d)),
    "param_effective": lambda s, d: shaped(P.effective(S.parameters(s, d), S.parameter_versions(s, d), S.parameter_overrides(s, d), AS_OF, BRAND)),
    "param_next_version": lambda s, d: P.next_version(S.parameter_versions(s, d), S.parameters(s, d)),
    "param_history": lambda s, d: shaped(P.history(S.parameter_versions(s, d), 3).select("key", "rn", "value", "status")),
    "param_snapshot": lambda s, d: P.snapshot(S.parameters(s, d).select("category", "key", F.col("default_value").alias("value"))),
    "job_queue_topk": lambda s, d: J.ready(S.jobs(s, d), "1998-01-01 00:00:00", 25).select("job_id", "priority"),
    "job_listing_page": lambda s, d: J.page(S.jobs(s, d), 40, 20, "completed", 2).select("job_id", "status", "brand"),
    "job_queue_stats": lambda s, d: shaped(J.queue_statistics(S.jobs(s, d))),
    "rate_limits": lambda s, d: J.rate_limited(S.jobs(s, d), 2),
    "next_stages": lambda s, d: J.next_stages(_steps(s, d)),
    "quarantine": lambda s, d: J.quarantined(_steps(s, d), S.jobs(s, d).select("job_id", (F.col("size") / 100000).alias("accuracy")).filter("accuracy < 0.2")),
    "wer_scores": lambda s, d: shaped(M.word_errors(_wer_pairs(s, d))),
    "body_accuracy": lambda s, d: shaped(M.body_accuracy(_wer_pairs(s, d).withColumnsRenamed({"reference": "truth", "hypothesis": "found"}))),
    "title_accuracy": lambda s, d: M.title_accuracy(S.table(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment").select("id", F.col("c_name").alias("truth"), F.when(F.col("id") % 3 == 0, F.col("c_mktsegment")).otherwise(F.upper("c_name")).alias("found"))),
    "contributor_accuracy": lambda s, d: shaped(M.contributor_accuracy(*(S.table(s, d, "supplier").select((F.col("s_nationkey")).alias("id"), F.concat(F.lit("dr "), F.regexp_replace("s_name", "#0*", " ")).alias("name"), F.when(F.col("s_suppkey") % k == 0, "Editor").otherwise("writer ").alias("role")) for k in (2, 4)))),
    "ocr_confusions": lambda s, d: M.confusions(_wer_pairs(s, d)),
    "problem_words": lambda s, d: M.problem_words(_wer_pairs(s, d)),
}

ORACLE_SQL = {
    "block_classify": oracle("blocks ruled", "SELECT doc_id, line_no, type FROM ruled WHERE type IS NOT NULL", "doc_id line_no type"),
    "single_title": oracle(
        "blocks ruled",
        "SELECT doc_id, line_no, CASE WHEN type = 'title' AND rn > 1 THEN 'heading' ELSE type END AS type, CASE WHEN type = 'title' AND rn > 1 THEN 0.9::DOUBLE * 0.8::DOUBLE ELSE CASE type WHEN 'title' THEN 0.9::DOUBLE WHEN 'page_number' THEN 0.9::DOUBLE WHEN 'caption' THEN 0.7::DOUBLE WHEN 'heading' THEN 0.7::DOUBLE WHEN 'body' THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END END AS confidence "
        "FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, type ORDER BY font_size DESC, line_no) AS rn FROM ruled WHERE type IS NOT NULL)",
        "doc_id line_no type ~confidence",
    ),
    "reading_order": oracle("blocks", "SELECT doc_id, page, line_no, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, line_no) - 1 AS INTEGER) AS reading_order FROM blocks", "doc_id page line_no reading_order"),
    "block_columns": oracle(
        "blocks",
        "SELECT doc_id, page, line_no, CAST(1 + sum(start) OVER (PARTITION BY doc_id, page ORDER BY cx RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS \"column\" FROM (SELECT *, CASE WHEN cx - lag(cx) OVER (PARTITION BY doc_id, page ORDER BY cx) > 60 THEN 1 ELSE 0 END AS start FROM (SELECT *, (x0 + x1) / 2 AS cx FROM blocks))",
        'doc_id page line_no "column"',
    ),
    "spatial_edges": oracle("blocks pairs", "SELECT * FROM relations", "doc_id page src dst relation ~confidence"),
    "pruned_edges": oracle("blocks pairs", "SELECT relation, count(*) AS edges FROM relations WHERE confidence >= 0.3::DOUBLE GROUP BY relation", "relation edges"),
    "caption_candidates": oracle("blocks images candidates", "SELECT * FROM candidates", "image_id line_no ~distance ~proximity match_type ~layout rank competitors"),
    "best_caption": oracle("blocks images candidates", "SELECT * FROM candidates WHERE rank = 1", "doc_id image_id line_no ~distance"),
    "match_confidence": oracle(
        "blocks images candidates",
        "SELECT image_id, line_no, (0.4::DOUBLE * proximity + 0.25::DOUBLE * 0.3::DOUBLE + 0.2::DOUBLE * layout + 0.15::DOUBLE * CASE WHEN competitors = 0 THEN 1.0::DOUBLE WHEN competitors <= 2 THEN 0.8::DOUBLE WHEN competitors <= 5 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) * (1 - 0.3::DOUBLE * least(1, competitors / 10)) AS confidence FROM candidates",
        "image_id line_no ~confidence",
    ),
    "title_normalize": "SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower('Dr. ' || c_name || ' &  Prof Co. ' || c_mktsegment), '\\s+', ' ', 'g')), '[^a-z0-9_ ''-]', '', 'g'), '\\bdr\\b', 'doctor', 'g'), '\\bprof\\b', 'professor', 'g') AS title FROM customer",
    "brand_from_name": oracle("files", "SELECT job_id, CASE job_id % 5 WHEN 0 THEN 'economist' WHEN 1 THEN 'time' WHEN 2 THEN 'vogue' WHEN 4 THEN 'wired' END AS brand, regexp_extract(name, '(\\d{4}-\\d{2}-\\d{2})', 1) AS issue_date FROM files", "job_id brand issue_date"),
    "graph_stats": oracle(
        "nodes",
        "SELECT n.doc_id, nodes, pages, node_confidence, coalesce(edges, 0) AS edges, coalesce(edge_confidence, 0) AS edge_confidence, coalesce(singletons, 0) AS singletons FROM (SELECT doc_id, count(*) AS nodes, count(DISTINCT page) AS pages, avg(confidence) AS node_confidence FROM nodes GROUP BY doc_id) n LEFT JOIN (SELECT doc_id, count(*) AS edges, avg(confidence) AS edge_confidence FROM edges GROUP BY doc_id) e USING (doc_id) "
        "LEFT JOIN (SELECT doc_id, count(*) AS singletons FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = n.doc_id AND (e.src = n.node OR e.dst = n.node)) GROUP BY doc_id) s USING (doc_id)",
        "doc_id nodes pages ~node_confidence edges ~edge_confidence singletons",
    ),
    "singletons": oracle("nodes", "SELECT doc_id, node FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = n.doc_id AND (e.src = n.node OR e.dst = n.node))", "doc_id node"),
    "graph_neighbours": oracle("nodes", "SELECT e.doc_id, e.src AS node, e.dst AS other, n.type FROM edges e JOIN nodes n ON n.doc_id = e.doc_id AND n.node = e.dst", "doc_id node other type"),
    "dangling_refs": oracle("nodes", "SELECT * FROM (SELECT doc_id, src, dst + CASE WHEN src % 3 = 0 THEN 100 ELSE 0 END AS dst FROM edges) e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.doc_id = e.doc_id AND n.node = e.dst)", "doc_id src dst"),
    "components": (
        "WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey - s_suppkey % 7 - s_nationkey % 2 * 7 AS b FROM supplier), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r(node, reached) AS (SELECT x, x FROM u UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.reached) SELECT node, min(reached) AS component FROM r GROUP BY node"
    ),
    "topological_order": oracle("nodes", "SELECT doc_id, node, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY node) - 1 AS INTEGER) AS position FROM nodes", "doc_id node position"),
    "param_effective": oracle(
        "parameters parameter_versions parameter_overrides",
        f"SELECT p.key, category, coalesce(o.value, v.value, default_value) AS value, CASE WHEN o.value IS NOT NULL THEN 'override' WHEN v.value IS NOT NULL THEN 'version' ELSE 'default' END AS origin FROM parameters p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, run DESC, patch DESC) AS rn FROM parameter_versions WHERE status = 'active') v ON v.key = p.key AND v.rn = 1 "
        f"LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority DESC, valid_from DESC, run DESC, patch DESC) AS rn FROM parameter_overrides WHERE brand = {BRAND} AND valid_from <= TIMESTAMP '{AS_OF}' AND valid_until > TIMESTAMP '{AS_OF}') o ON o.key = p.key AND o.rn = 1",
        "key category ~value origin",
    ),
    "param_next_version": oracle(
        "parameters parameter_versions", "SELECT p.key, CASE WHEN patch IS NULL THEN '1.0.0' ELSE '1.0.' || CAST(patch + 1 AS VARCHAR) END AS next_version FROM parameters p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, run DESC, patch DESC) AS rn FROM parameter_versions) v ON v.key = p.key AND v.rn = 1", "key next_version"
    ),
    "param_history": oracle("parameter_versions", "SELECT * FROM (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY created_at DESC, run DESC, patch DESC) AS INTEGER) AS rn, value, status FROM parameter_versions) WHERE rn <= 3", "key rn ~value status"),
    "param_snapshot": oracle("parameters", "SELECT category, snapshot, sha256(snapshot) AS hash FROM (SELECT category, '{' || string_agg('\"' || key || '\":' || format('{:.2f}', default_value), ',' ORDER BY key) || '}' AS snapshot FROM parameters GROUP BY category)", "category snapshot hash"),
    "job_queue_topk": oracle("jobs", "SELECT job_id, priority FROM jobs WHERE status = 'pending' AND scheduled_at <= TIMESTAMP '1998-01-01 00:00:00' ORDER BY priority DESC, created_at, job_id LIMIT 25", "job_id priority"),
    "job_listing_page": oracle("jobs", "SELECT job_id, status, brand FROM jobs WHERE status = 'completed' AND brand = 2 ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40", "job_id status brand"),
    "job_queue_stats": oracle("jobs", "SELECT status, count(*) AS n, CASE WHEN status = 'running' THEN count(*) / 4 ELSE 0 END AS utilisation FROM jobs GROUP BY status", "status n ~utilisation"),
    "rate_limits": oracle("jobs", "SELECT brand, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS runs, count(*) >= 2 AS limited, CASE WHEN count(*) >= 2 THEN strftime(max(CAST(created_at AS DATE)) + INTERVAL 1 DAY, '%Y-%m-%d') END AS next_allowed FROM jobs GROUP BY 1, 2", "brand day runs limited next_allowed"),
    "next_stages": oracle(
        "jobs steps",
        "SELECT j.job_id, n.stage FROM (SELECT DISTINCT job_id FROM steps) j CROSS JOIN needs n LEFT JOIN steps d ON d.job_id = j.job_id AND d.stage = n.needs AND d.status = 'completed' WHERE NOT EXISTS (SELECT 1 FROM steps b WHERE b.job_id = j.job_id AND b.stage = n.stage AND (b.status IN ('completed', 'in_progress') OR b.status = 'failed' AND b.attempts >= 3)) GROUP BY j.job_id, n.stage HAVING count(*) = count(d.stage)",
        "job_id stage",
    ),
    "quarantine": oracle("jobs steps", "SELECT job_id FROM jobs WHERE size / 100000 < 0.2::DOUBLE UNION SELECT job_id FROM steps WHERE stage IN ('layout_analysis', 'article_reconstruction') AND status = 'failed'", "job_id"),
    "title_accuracy": "SELECT c_custkey AS id, regexp_replace(lower(c_name), '[^a-z0-9_ ''-]', '', 'g') AS truth_title, c_custkey % 3 <> 0 AS correct FROM customer",
    "block_simple_class": oracle(
        "blocks",
        "SELECT doc_id, line_no, CASE WHEN regexp_matches(lower(trim(text)), '^(?:page\\s*)?\\d+$') THEN 'page_number' WHEN n_words <= 10 AND font_size > 14 THEN 'title' WHEN lower(trim(text)) LIKE 'by %' OR contains(lower(text), 'correspondent') THEN 'byline' WHEN font_size < 10 THEN 'caption' ELSE 'body' END AS type, "
        "CASE WHEN font_size >= 18 THEN 'title' WHEN font_size >= 14 OR is_bold THEN 'heading' WHEN font_size < 9 THEN 'footnote' ELSE 'paragraph' END AS text_type FROM blocks",
        "doc_id line_no type text_type",
    ),
    "contributor_accuracy": oracle(
        "",
        "SELECT t.s_nationkey AS id, count(f.role) AS correct, count(*) AS total, count(f.role) / count(*) AS accuracy FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 'editor' ELSE 'writer' END AS role FROM supplier) t LEFT JOIN (SELECT *, CASE WHEN s_suppkey % 4 = 0 THEN 'editor' ELSE 'writer' END AS role FROM supplier) f ON t.s_nationkey = f.s_nationkey AND t.s_name = f.s_name AND t.role = f.role GROUP BY 1",
        "id correct total ~accuracy",
    ),
    "name_parse": oracle(
        "",
        "SELECT s_suppkey, 'Ana' AS given, 'Maria ' || regexp_extract(s_name, '^([^#]*)#', 1) AS middle, regexp_extract(s_name, '#(.*)$', 1) AS family, 'Dr' AS prefix, 'Jr' AS suffix, 0.95::DOUBLE AS confidence FROM supplier",
        "s_suppkey given middle family prefix suffix ~confidence",
    ),
    "ocr_confusions": (
        "WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), k AS (SELECT item_id, i, w[CAST(i AS INTEGER) + 1] AS x FROM (SELECT item_id, w, unnest(range(0, len(w))) AS i FROM w)), "
        "h AS (SELECT item_id, string_agg(CASE WHEN i % 5 = 4 THEN x || 'x' ELSE x END, ' ' ORDER BY i) AS t FROM k WHERE i % 7 <> 6 AND x <> '' GROUP BY item_id), "
        "z AS (SELECT list_zip(list_filter(regexp_split_to_array(b.text, '\\s+'), lambda v: v <> ''), list_filter(regexp_split_to_array(h.t, '\\s+'), lambda v: v <> '')) AS z FROM benchmark b JOIN h USING (item_id)), "
        "p AS (SELECT u[1] AS r, u[2] AS h FROM (SELECT unnest(z) AS u FROM z)), c AS (SELECT r, h, unnest(range(1, least(length(r), length(h)) + 1)) AS i FROM p WHERE r IS NOT NULL AND h IS NOT NULL AND r <> h) "
        "SELECT substr(r, i, 1) AS expected, substr(h, i, 1) AS read, count(*) AS n FROM c WHERE substr(r, i, 1) <> substr(h, i, 1) GROUP BY 1, 2"
    ),
    "article_scores": oracle(
        "nodes",
        "SELECT doc_id, article, count(*) AS components, CAST(sum(n_words) AS BIGINT) AS words, least(1, 0.8::DOUBLE * avg(confidence) + 0.2::DOUBLE * least(1, count(*) / 10)) AS confidence, least(1, CASE WHEN bool_or(type = 'title') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN count(*) FILTER (WHERE type = 'body') > 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN count(*) FILTER (WHERE type = 'body') > 1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN sum(n_words) >= 50 THEN 0.1::DOUBLE ELSE 0 END) AS completeness, "
        "bool_or(type = 'title') AS titled, bool_or(type = 'advertisement') AS ad, least(1, 0.8::DOUBLE * avg(confidence) + 0.2::DOUBLE * least(1, count(*) / 10)) >= 0.4::DOUBLE AND sum(n_words) >= 50 AND bool_or(type = 'title') AS accepted "
        "FROM (SELECT n.*, w.n_words, CAST(dense_rank() OVER (PARTITION BY n.doc_id ORDER BY n.page) - 1 AS INTEGER) AS article FROM nodes n JOIN (SELECT conv_id AS doc_id, turn AS node, CAST(len(list_filter(regexp_split_to_array(min(text), '\\s+'), lambda v: v <> '')) AS INTEGER) AS n_words FROM conversations GROUP BY 1, 2) w ON n.doc_id = w.doc_id AND n.node = w.node WHERE n.type <> 'header') GROUP BY doc_id, article",
        "doc_id article components words ~confidence ~completeness titled ad accepted",
    ),
    "block_heuristics": oracle("blocks guessed", "SELECT * FROM guessed", "doc_id line_no type ~confidence"),
    "block_class_counts": oracle(
        "blocks ruled guessed",
        f"SELECT coalesce(r.type, g.type) AS type, count(*) AS blocks, avg(coalesce(r.sure, g.confidence)) AS confidence FROM guessed g LEFT JOIN (SELECT doc_id, line_no, type, {_RULE_SURE} AS sure FROM ruled WHERE type IS NOT NULL) r ON r.doc_id = g.doc_id AND r.line_no = g.line_no GROUP BY 1",
        "type blocks ~confidence",
    ),
    "article_traversal": oracle("nodes", "SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS INTEGER) AS article, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY node) - 1 AS INTEGER) AS place, node FROM nodes WHERE type <> 'header'", "doc_id article place node"),
    "continuation_markers": (
        "SELECT p_partkey, pattern, marker, type, target, confidence FROM (SELECT p_partkey, 0 AS pattern, 'continued on page ' || p_size AS marker, 'forward' AS type, p_size AS target, 1.0::DOUBLE AS confidence FROM part UNION ALL SELECT p_partkey, 1, 'see page 4', 'jump', 4, 1.0::DOUBLE FROM part UNION ALL SELECT p_partkey, 7, '(cont.)', 'forward', NULL, 0.5::DOUBLE FROM part)"
    ),
    "title_case_ratio": oracle(
        "blocks",
        "SELECT doc_id, line_no, CASE WHEN len(w) < 2 THEN 0 ELSE list_sum(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN CASE WHEN regexp_matches(substr(x, 1, 1), '\\p{Lu}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN regexp_replace(lower(x), '[^a-z]', '', 'g') IN ("
        + ", ".join(f"'{w}'" for w in T.MINOR)
        + ") THEN CASE WHEN regexp_matches(substr(x, 1, 1), '\\p{Lu}') THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END WHEN regexp_matches(substr(x, 1, 1), '\\p{Lu}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) / len(w) END AS share FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda v: v <> '') AS w FROM blocks WHERE n_words BETWEEN 3 AND 20)",
        "doc_id line_no ~share",
    ),
}
