"""Registered queries over listings, accuracy reports, validation, names, graphs and files, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as B
from quire.functions import text as T
from quire.operators import accuracy as A
from quire.operators import calibration as K
from quire.operators import contributors as C
from quire.operators import evaluation as E
from quire.operators import graphs as G
from quire.operators import jobs as J
from quire.operators import layout as L
from quire.operators import listings as I
from quire.operators import matching as M
from quire.operators import parameters as P
from quire.operators import reports as R
from quire.operators import resolution as Z
from quire.operators import validation as V
from quire.plans.documents import _candidates, _nodes
from quire.plans.reports import _matches, _sure
from quire.plans.shape import oracle, shaped
from quire.sources import sinks
from quire.sources import standins as S

_LINE = ["l_orderkey AS doc_id", "CAST(l_linenumber AS BIGINT) AS article_id"]


def _field(s, d, correct, total="1"):
    return S.table(s, d, "lineitem").selectExpr(*_LINE, f"CAST({correct} AS BIGINT) AS c", f"CAST({total} AS BIGINT) AS t").groupBy("doc_id", "article_id").agg(F.min("c").alias("correct"), F.min("t").alias("total"))


def _accuracies(s, d):
    """The media frame lacks the articles of some orders, as if these had not been found."""
    articles = S.table(s, d, "lineitem").selectExpr(*_LINE).distinct()
    media = S.table(s, d, "lineitem").filter("l_suppkey % 3 > 0").selectExpr(*_LINE, "2L AS t", "CAST(l_suppkey % 3 AS BIGINT) AS c").groupBy("doc_id", "article_id").agg(F.min("c").alias("correct"), F.min("t").alias("total"))
    return A.article_accuracy(articles, title=_field(s, d, "CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END"), body=_field(s, d, "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END"), contributors=_field(s, d, "l_partkey % 3", "2 + l_partkey % 2"), media=media)


S.SQL["accuracies"] = (
    "fields AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS article_id, CAST(min(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS title_correct, 1::BIGINT AS title_total, CAST(min(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS body_correct, 1::BIGINT AS body_total, "
    "CAST(min(l_partkey % 3) AS BIGINT) AS contributors_correct, CAST(min(2 + l_partkey % 2) AS BIGINT) AS contributors_total, CAST(coalesce(min(CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 END), 0) AS BIGINT) AS media_correct, CASE WHEN max(l_suppkey % 3) > 0 THEN 2::BIGINT ELSE 1::BIGINT END AS media_total FROM lineitem GROUP BY 1, 2), "
    "accuracies AS (SELECT *, 0.3::DOUBLE * title + 0.4::DOUBLE * body + 0.2::DOUBLE * contributors + 0.1::DOUBLE * media AS weighted FROM (SELECT *, title_correct / greatest(1, title_total) AS title, body_correct / greatest(1, body_total) AS body, contributors_correct / greatest(1, contributors_total) AS contributors, media_correct / greatest(1, media_total) AS media FROM fields)), "
    "report AS (SELECT *, " + ", ".join(f"round_even(100 * {f}_correct / greatest(1, {f}_total), 2) AS {f}_percent" for f in A.WEIGHTS) + ", round_even(100 * score, 2) AS percent FROM (SELECT doc_id, count(*) AS articles, "
    + ", ".join(f"CAST(sum({f}_{x}) AS BIGINT) AS {f}_{x}" for f in A.WEIGHTS for x in ("correct", "total")) + ", avg(weighted) AS score FROM accuracies GROUP BY doc_id))"
)
_REPORT = "doc_id articles " + " ".join(f"{f}_correct {f}_total ~{f}_percent" for f in A.WEIGHTS) + " ~score ~percent"


def _paths(s, d):
    return S.table(s, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber % 2 AS conflict", "CAST(l_linenumber AS BIGINT) AS path_id", "l_quantity AS length", "1 - l_discount AS confidence", "l_partkey % 6 AS kinds", "l_suppkey % 7 AS pages", "l_partkey % 2 = 0 AS has_title", "l_suppkey % 3 > 0 AS has_body")


def _scored_paths(s, d):
    score = F.round(G.path_score(*map(F.col, ("confidence", "length", "kinds", "pages", "has_title", "has_body"))), 9)
    return _paths(s, d).groupBy("doc_id", "conflict", "path_id").agg(F.max(score).alias("score"))


S.SQL["paths"] = (
    "paths AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS conflict, CAST(l_linenumber AS BIGINT) AS path_id, max(round(0.4::DOUBLE * (1 - l_discount) + 0.2::DOUBLE * least(1, l_quantity / 20) + 0.15::DOUBLE * least(1, (l_partkey % 6) / 5) + 0.1::DOUBLE * least(1, (l_suppkey % 7) / 5) "
    "+ CASE WHEN l_partkey % 2 = 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN l_suppkey % 3 > 0 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN l_partkey % 2 = 0 AND l_suppkey % 3 > 0 THEN 0.1::DOUBLE ELSE 0 END, 9)) AS score FROM lineitem GROUP BY 1, 2, 3)"
)


def _starts(s, d):
    """Nodes with a place, a font and a mark of title case."""
    return _nodes(s, d).withColumns({"y0": (F.col("node") * 37 % 400).cast("double"), "font": (10 + F.col("node") % 9).cast("double"), "cased": F.col("node") % 3 == 0})


S.SQL["starts"] = (
    "starts AS (SELECT conv_id AS doc_id, turn AS node, CASE WHEN turn % 8 = 0 THEN 'title' WHEN min(role) = 'system' THEN 'header' ELSE 'body' END AS type, 1 - (turn % 5) / 10 AS confidence, CAST(turn * 37 % 400 AS DOUBLE) AS y0, CAST(10 + turn % 9 AS DOUBLE) AS font, turn % 3 = 0 AS cased, min(text) AS text, "
    "len(list_filter(regexp_split_to_array(trim(min(text)), '\\s+'), lambda w: w <> '')) AS n_words FROM conversations GROUP BY conv_id, turn)"
)


def _structures(s, d):
    """Articles of order lines: titles, bodies and roles follow from numbers."""
    rows = S.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pick = lambda col, *values: F.element_at(F.array(*values), (F.col(col) % len(values) + 1).cast("int"))
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("id"), (F.col("l_partkey") % 40).alias("first_page"), (F.col("l_partkey") % 40 + F.col("l_suppkey") % 14 - 1).alias("last_page"),
        pick("l_partkey", strings("One"), strings(" "), strings(), strings("a", "b"), F.array(F.repeat(F.lit("long "), F.lit(70)))).alias("titles"),
        pick("l_suppkey", strings(), strings("short"), F.array(F.repeat(F.lit("word "), F.lit(20)), F.lit(" "))).alias("bodies"), pick("l_partkey", strings("author"), strings("author", "poet"), strings()).alias("roles"),
    )


S.SQL["structures"] = (
    "structures AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS id, l_partkey % 40 AS f, l_partkey % 40 + l_suppkey % 14 - 1 AS l, l_partkey % 5 AS t, l_suppkey % 3 AS b, l_partkey % 3 AS r FROM lineitem), "
    "checked AS (SELECT id, CAST((CASE WHEN f > l THEN 1 ELSE 0 END) + (CASE WHEN t IN (1, 2, 3) THEN 1 ELSE 0 END) + (CASE WHEN b = 0 THEN 1 ELSE 0 END) AS INTEGER) AS errors, "
    "CAST((CASE WHEN l - f > 10 THEN 1 ELSE 0 END) + (CASE WHEN t = 4 THEN 1 ELSE 0 END) + (CASE WHEN b = 0 THEN 0 ELSE 1 END) + (CASE WHEN r = 1 THEN 1 ELSE 0 END) AS INTEGER) AS warnings FROM structures)"
)


def _names(s, d):
    """Names made of customers' segments: plain, hyphened, with an apostrophe, or after mc and mac."""
    low = F.lower(F.col("c_mktsegment"))
    family = F.element_at(F.array(low, F.concat(low, F.lit("-"), F.upper(low)), F.concat(F.lit("o'"), low), F.concat(F.lit("mc"), low), F.concat(F.lit("mac"), low)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return S.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, "Dr.").otherwise("").alias("prefix"), F.lit("ann").alias("given"), F.when(F.col("c_custkey") % 3 == 0, "q").when(F.col("c_custkey") % 3 == 1, "r.").otherwise("sue").alias("middle"), F.when(F.col("c_custkey") % 7 > 0, family).otherwise("").alias("family"), F.when(F.col("c_custkey") % 6 == 0, "Jr.").otherwise("").alias("suffix"))


def _formatted(s, d):
    parts = [F.col("prefix"), T.capitalised(F.col("given")), T.initial(F.col("middle")), T.capitalised(F.col("family")), F.col("suffix")]
    return _names(s, d).select("id", T.full_name(*parts).alias("full_name"), T.last_first(*parts).alias("last_first"), T.name_confidence(F.col("given"), F.col("given"), F.col("family"), (F.col("prefix") != "") | (F.col("suffix") != "")).alias("confidence"))


_CAP = lambda x: f"upper(left({x}, 1)) || lower(substr({x}, 2))"
S.SQL["persons"] = (
    "raw_persons AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'Dr.' ELSE '' END AS prefix, CASE c_custkey % 3 WHEN 0 THEN 'Q.' WHEN 1 THEN 'R.' ELSE 'sue' END AS middle, lower(c_mktsegment) AS w, c_custkey % 5 AS k, c_custkey % 7 > 0 AS named, CASE WHEN c_custkey % 6 = 0 THEN 'Jr.' ELSE '' END AS suffix FROM customer), "
    f"persons AS (SELECT *, 'Ann' AS given, CASE WHEN NOT named THEN '' WHEN k = 0 AND starts_with(w, 'mac') THEN 'MaC' || substr(w, 4) WHEN k = 0 THEN {_CAP('w')} WHEN k = 1 THEN {_CAP('w')} || '-' || {_CAP('w')} WHEN k = 2 THEN 'O' || chr(39) || {_CAP('w')} WHEN k = 3 THEN 'Mc' || {_CAP('w')} ELSE 'MaC' || w END AS family FROM raw_persons)"
)
_JOINED = "array_to_string(list_filter([{}], lambda x: x <> ''), ' ')"


def _texts(s, d):
    return S.blocks(s, d).select("doc_id", "line_no", "text")


def _found_matches(s, d):
    return S.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 60).alias("start"), (F.col("l_partkey") % 60 + F.col("l_quantity").cast("long")).alias("stop"), F.when(F.col("l_linenumber") % 2 == 0, "ner").otherwise("pattern").alias("method"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.concat(F.lit("n"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("name"))


def _pages(s, d):
    return S.table(s, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS page", "1 - l_discount * 0.9173D AS confidence", "CAST(l_quantity AS BIGINT) * (l_orderkey % 4) AS characters", "l_orderkey % 2 = 0 AS is_digital")


def _methods(s, d):
    return S.table(s, d, "lineitem").selectExpr("l_orderkey AS id", "concat('m', l_linenumber) AS method", "cast(round(l_tax * 100) AS BIGINT) * (l_partkey % 9) / 103D AS wer")


def _evaluated(s, d):
    return S.document_evaluations(s, d)


def _boxes(s, d):
    """Every image with a box found for it."""
    i = S.images(S.blocks(s, d))
    sizes = {"b_x0": F.col("x0") + F.col("page") % 7, "b_y0": F.col("y0") + 5, "b_x1": F.col("x1") + 10, "b_y1": F.col("y1") - F.col("page") % 11}
    return i.withColumns({f"a_{c}": F.col(c) for c in ("x0", "y0", "x1", "y1")} | sizes)


S.SQL["boxes"] = (
    "boxes AS (SELECT image_id, x0, y0, x1, y1, x0 + page % 7 AS p0, y0 + 5 AS q0, x1 + 10 AS p1, y1 - page % 11 AS q1 FROM images), "
    "shares AS (SELECT *, (x1 - x0) / greatest(1, y1 - y0) AS r, (p1 - p0) / greatest(1, q1 - q0) AS t, greatest(0, least(x1, p1) - greatest(x0, p0)) * greatest(0, least(y1, q1) - greatest(y0, q0)) AS shared FROM boxes)"
)
_AS_OF = "1997-06-01 12:00:00"

QUERIES = {
    "nodes_of_type": lambda s, d: G.nodes_of(_nodes(s, d), kind="title").select("doc_id", "node", "page"),
    "nodes_of_page": lambda s, d: G.nodes_of(_nodes(s, d), page=0).select("doc_id", "node", "type"),
    "edges_of_type": lambda s, d: (lambda n: G.edges_of(G.follows(n), "follows").select("doc_id", "src", "dst"))(_nodes(s, d)),
    "graph_predecessors": lambda s, d: (lambda n: G.neighbours(G.follows(n), n, forward=False).select("doc_id", "node", "other", "type"))(_nodes(s, d)),
    "merged_graph": lambda s, d: (lambda n: G.merged(n.filter("node % 2 = 0").select("doc_id", "node", "type"), n.filter("node % 3 = 0").select("doc_id", "node", "type")))(_nodes(s, d)),
    "article_components": lambda s, d: _nodes(s, d).filter(G.is_component(F.col("type"), F.col("confidence"), F.col("text"))).select("doc_id", "node", "type"),
    "article_starts": lambda s, d: _starts(s, d).select("doc_id", "node", G.is_article_start(*map(F.col, ("type", "confidence", "y0", "font", "n_words", "cased"))).alias("starts"), F.round(G.start_score(*map(F.col, ("type", "confidence", "y0", "font", "n_words", "cased"))), 6).alias("score")),
    "path_scores": lambda s, d: shaped(_scored_paths(s, d).select("doc_id", "path_id", "score")),
    "best_path": lambda s, d: shaped(Z.best_path(_scored_paths(s, d))),
    "connection_scores": lambda s, d: shaped(S.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", G.connection_score(F.lit(0.5), F.col("l_quantity") * 25, 1 - F.col("l_discount"), F.col("l_returnflag") == "R").alias("score")).groupBy("l_orderkey", "l_linenumber").agg(F.max("score").alias("score"))),
    "article_full_text": lambda s, d: (lambda n: G.full_text(n.select("doc_id", F.col("page").alias("article"), F.col("node").alias("place"), "type", "text")))(_nodes(s, d)),
    "follow_continuations": lambda s, d: (lambda n: Z.follow_continuations(n.filter("node % 5 = 0").select("doc_id", F.col("node").alias("src"), "page", F.when(F.col("node") % 2 == 0, F.col("page")).alias("target")), n.withColumn("y0", F.lit(200.0))))(_nodes(s, d)),
    "image_scores": lambda s, d: shaped(_boxes(s, d).select("image_id", B.image_score(B.side("a"), B.side("b")).alias("score"))),
    "thousandth_boxes": lambda s, d: _boxes(s, d).select("image_id", F.array_join(B.normalised(B.side("a"), 600.0, 800.0), " ").alias("box")),
    "ocr_labels": lambda s, d: S.table(s, d, "lineitem").groupBy(K.ocr_quality(F.col("l_tax"), F.col("l_discount")).alias("label")).agg(F.count("*").alias("n")),
    "safe_filenames": lambda s, d: S.table(s, d, "part").select("p_partkey", T.safe_filename(F.concat_ws("/", "p_name", "p_type", "p_brand"), 24).alias("name")),
    "unique_filenames": lambda s, d: L.unique_filenames(S.table(s, d, "part").select(F.col("p_partkey").alias("image_id"), F.concat(F.col("p_brand"), F.lit(".jpg")).alias("filename"))),
    "accepted_contributors": lambda s, d: C.accepted(S.table(s, d, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS n", "1 - 4 * l_discount AS confidence", "1 - 4 * l_tax AS role_confidence", "l_quantity / 50 AS name_confidence")).groupBy("id").agg(F.count("*").alias("n")),
    "job_priorities": lambda s, d: S.jobs(s, d).select("job_id", J.priority(F.element_at(F.array(F.lit("economist"), F.lit("Time"), F.lit("none"), F.lit("vogue")), F.col("brand") + 1), (F.col("job_id") % 40).cast("double")).alias("points")),
    "flattened_parameters": lambda s, d: R.flattened(S.table(s, d, "part").select(F.col("p_brand").alias("category"), F.create_map(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_size")).alias("values"))).select("key", "value", "hash"),
    "rollback_values": lambda s, d: shaped(P.rollback(S.parameter_versions(s, d), S.parameters(s, d).select("key", F.col("default_value").alias("value")))),
    "documents_of_run": lambda s, d: I.listed(S.article_evaluations(s, d).select("doc_id", "article_id", "brand", "title"), F.asc("doc_id"), F.asc("article_id"), F.asc("title"), skip=5, size=20, brand=2).transform(shaped),
    "recent_tuning_runs": lambda s, d: shaped(I.newest(_evaluated(s, d).select("event_id", "metric", "brand", "accuracy", "ts"), "ts", "event_id", size=15, brand=1).select("event_id", "metric", "accuracy")),
    "tuning_events": lambda s, d: I.newest(S.jobs(s, d).select("job_id", "status", "created_at"), "created_at", "job_id", skip=10, size=25, status="completed").select("job_id", "status"),
    "experiments_newest": lambda s, d: I.newest(S.jobs(s, d), "created_at", "job_id", size=30, brand=3, status="pending").select("job_id", "brand", "priority"),
    "evaluations_page": lambda s, d: shaped(I.newest(_evaluated(s, d), "ts", "event_id", skip=40, size=20).select("event_id", "metric", "accuracy")),
    "article_accuracy": lambda s, d: shaped(_accuracies(s, d).select("doc_id", "article_id", *A.WEIGHTS, "weighted")),
    "accuracy_report": lambda s, d: shaped(A.accuracy_report(_accuracies(s, d))),
    "accuracy_json": lambda s, d: A.serialised(A.accuracy_report(_accuracies(s, d))),
    "article_structure": lambda s, d: V.article_structure(_structures(s, d)),
    "dataset_quality": lambda s, d: shaped(V.dataset_quality(S.table(s, d, "lineitem").selectExpr("l_linenumber % 4 AS errors", "l_suppkey % 3 AS warnings", "l_tax * 10 AS quality"))),
    "annotation_consistency": lambda s, d: V.annotation_consistency(S.table(s, d, "lineitem").selectExpr("l_orderkey AS doc_id", "CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS type", "CASE l_partkey % 4 WHEN 0 THEN '0.5' WHEN 1 THEN 'high' WHEN 2 THEN '1.5' END AS confidence")),
    "document_ocr_quality": lambda s, d: shaped(R.document_ocr_quality(_pages(s, d))),
    "role_statistics": lambda s, d: shaped(R.role_statistics(S.table(s, d, "lineitem").selectExpr("l_returnflag AS role", "1 - 4 * l_discount AS confidence"))),
    "layout_accuracy": lambda s, d: shaped(R.layout_accuracy(_sure(s, d).select("doc_id", "confidence"))),
    "compared_methods": lambda s, d: shaped(R.compared_methods(_methods(s, d))),
    "understanding": lambda s, d: (lambda n: shaped(R.understanding(n, G.follows(n))))(_nodes(s, d)),
    "rolling_limits": lambda s, d: J.rolling_limit(S.jobs(s, d), _AS_OF).withColumn("next_allowed", F.date_format("next_allowed", "yyyy-MM-dd HH:mm:ss")),
    "layout_patterns": lambda s, d: Z.layout_pattern(Z.conflict_groups(_matches(s, d))).groupBy("pattern").agg(F.count("*").alias("groups"), F.sum("images").alias("images"), F.sum("captions").alias("captions")),
    "window_significance": lambda s, d: shaped(E.window_significance(_evaluated(s, d))),
    "named_continuations": lambda s, d: (lambda n: n.select("doc_id", "node", T.names_continuation(F.concat(F.col("text"), F.when(F.col("node") % 3 == 0, " Continued on page 4").otherwise("")), F.col("type")).alias("named")))(_nodes(s, d)),
    "ocr_block_types": lambda s, d: _texts(s, d).groupBy(T.ocr_block_type(F.col("text")).alias("type")).agg(F.count("*").alias("blocks")),
    "name_formats": lambda s, d: shaped(_formatted(s, d)),
    "combined_matches": lambda s, d: shaped(C.combined(_found_matches(s, d))),
    "layout_markup": lambda s, d: sinks.layout_xml(L.classify(S.blocks(s, d))),
    "media_accuracy": lambda s, d: M.media_accuracy(S.images(S.blocks(s, d)).withColumn("caption", F.col("image_id")), S.images(S.blocks(s, d)).withColumn("caption", F.when(F.col("page") % 2 == 0, F.col("image_id")).otherwise(""))),
    "matched_articles": lambda s, d: M.matched_articles(*(S.table(s, d, "conversations").filter("role = 'user'").groupBy(F.floor(F.col("conv_id") / 10).cast("long").alias("doc_id"), (F.col("conv_id") + k * (F.col("conv_id") % 2) * 1000).alias("article_id")).agg(F.min_by("text", F.struct("turn", "text")).alias("title")) for k in (0, 1))),
}

_KEEP = "type NOT IN ('header', 'footer', 'page_number', 'advertisement')"
_START = "CASE WHEN type = 'title' THEN confidence >= 0.7::DOUBLE WHEN type IN ('subtitle', 'heading') THEN confidence >= 0.9::DOUBLE ELSE n_words BETWEEN 3 AND 20 AND y0 <= 300 AND font >= 14 AND cased END"
_START_SCORE = (
    "least(1, 0.4::DOUBLE * confidence + CASE type WHEN 'title' THEN 0.3::DOUBLE WHEN 'subtitle' THEN 0.2::DOUBLE WHEN 'heading' THEN 0.1::DOUBLE ELSE 0 END + 0.2::DOUBLE * greatest(0, 1 - y0 / 500) + CASE WHEN font > 16 THEN 0.1::DOUBLE ELSE 0 END "
    "+ CASE WHEN n_words BETWEEN 5 AND 12 THEN 0.1::DOUBLE WHEN n_words BETWEEN 3 AND 20 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN cased THEN 0.1::DOUBLE ELSE 0 END)"
)
_CREDIT = " OR ".join(f"contains(lower(trim(text)), '{w}')" for w in T.CREDIT_WORDS)
_CAPTIONED = " OR ".join(f"contains(lower(trim(text)), '{w}')" for w in T.CAPTION_WORDS)
_THETA = "atan(abs(t_stat) / 3)"

ORACLE_SQL = {
    "nodes_of_type": oracle("nodes", "SELECT doc_id, node, page FROM nodes WHERE type = 'title'", "doc_id node page"),
    "nodes_of_page": oracle("nodes", "SELECT doc_id, node, type FROM nodes WHERE page = 0", "doc_id node type"),
    "edges_of_type": oracle("nodes", "SELECT doc_id, src, dst FROM edges", "doc_id src dst"),
    "graph_predecessors": oracle("nodes", "SELECT e.doc_id, e.dst AS node, e.src AS other, n.type FROM edges e JOIN nodes n ON n.doc_id = e.doc_id AND n.node = e.src", "doc_id node other type"),
    "merged_graph": oracle("nodes", "SELECT doc_id, node, type FROM nodes WHERE node % 2 = 0 OR node % 3 = 0", "doc_id node type"),
    "article_components": oracle("starts", f"SELECT doc_id, node, type FROM starts WHERE confidence >= 0.3::DOUBLE AND length(trim(text)) >= 10 AND {_KEEP}", "doc_id node type"),
    "article_starts": oracle("starts", f"SELECT doc_id, node, {_START} AS starts, {_START_SCORE} AS score FROM starts", "doc_id node starts ~score"),
    "path_scores": oracle("paths", "SELECT doc_id, path_id, score FROM paths", "doc_id path_id ~score"),
    "best_path": oracle("paths", "SELECT DISTINCT ON (doc_id, conflict) doc_id, conflict, path_id, score FROM paths ORDER BY doc_id, conflict, score DESC, path_id", "doc_id conflict path_id ~score"),
    "connection_scores": oracle("parameters", "SELECT l_orderkey, l_linenumber, max(0.3::DOUBLE * greatest(0, least(1, 1 - l_quantity * 25 / 1000)) + 0.4::DOUBLE * (1 - l_discount) + CASE WHEN l_returnflag = 'R' THEN 0.3::DOUBLE ELSE 0 END) AS score FROM lineitem GROUP BY 1, 2", "l_orderkey l_linenumber ~score"),
    "article_full_text": oracle(
        "starts",
        "SELECT doc_id, CAST(node // 8 AS INTEGER) AS article, regexp_replace(string_agg(CASE WHEN type IN ('title', 'subtitle', 'heading') THEN chr(10) || chr(10) || trim(text) || chr(10) ELSE trim(text) || chr(10) || chr(10) END, '' ORDER BY node), '^\\s+|\\s+$', '', 'g') AS full_text FROM starts WHERE trim(text) <> '' GROUP BY 1, 2",
        "doc_id article full_text",
    ),
    "image_scores": oracle("blocks images boxes", "SELECT image_id, 0.7::DOUBLE * shared / greatest((x1 - x0) * (y1 - y0) + (p1 - p0) * (q1 - q0) - shared, 1e-6::DOUBLE) + 0.3::DOUBLE * greatest(0, 1 - abs(r - t) / greatest(r, t, 1)) AS score FROM shares", "image_id ~score"),
    "thousandth_boxes": oracle("blocks images boxes", "SELECT image_id, concat_ws(' ', CAST(trunc(x0 * 1000 / 600) AS INTEGER), CAST(trunc(y0 * 1000 / 800) AS INTEGER), CAST(trunc(x1 * 1000 / 600) AS INTEGER), CAST(trunc(y1 * 1000 / 800) AS INTEGER)) AS box FROM boxes", "image_id box"),
    "ocr_labels": "SELECT CASE WHEN l_tax <= 0.001::DOUBLE AND l_discount <= 0.001::DOUBLE THEN 'excellent' WHEN l_tax <= 0.02::DOUBLE THEN 'good' WHEN l_tax <= 0.05::DOUBLE THEN 'acceptable' WHEN l_tax <= 0.1::DOUBLE THEN 'poor' ELSE 'failed' END AS label, count(*) AS n FROM lineitem GROUP BY 1",
    "safe_filenames": "SELECT p_partkey, left(regexp_replace(regexp_replace(regexp_replace(lower(concat_ws('/', p_name, p_type, p_brand)), '[^a-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 24) AS name FROM part",
    "unique_filenames": "SELECT p_partkey AS image_id, p_brand || '.jpg' AS filename, CASE WHEN k = 0 THEN p_brand || '.jpg' ELSE p_brand || '_' || CASE WHEN k < 10 THEN '0' ELSE '' END || k || '.jpg' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)",
    "accepted_contributors": "SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE 1 - 4 * l_discount >= 0.8::DOUBLE AND 1 - 4 * l_tax >= 0.7::DOUBLE AND l_quantity / 50 >= 0.8::DOUBLE GROUP BY 1",
    "job_priorities": oracle("jobs", "SELECT job_id, CAST(CASE brand " + " ".join(f"WHEN {k} THEN {J.BRAND_PRIORITY.get(b, 0)}" for k, b in enumerate(("economist", "time", "none", "vogue"))) + " END + CASE WHEN job_id % 40 < 1 THEN 5 WHEN job_id % 40 < 24 THEN 2 ELSE 0 END AS INTEGER) AS points FROM jobs", "job_id points"),
    "flattened_parameters": "SELECT p_brand || '.p' || p_partkey AS key, p_size AS value, sha256(CAST(p_size AS VARCHAR)) AS hash FROM part",
    "documents_of_run": oracle("article_evaluations", "SELECT doc_id, article_id, brand, title FROM article_evaluations WHERE brand = 2 ORDER BY doc_id, article_id, title LIMIT 20 OFFSET 5", "doc_id article_id brand ~title"),
    "recent_tuning_runs": oracle("document_evaluations", "SELECT event_id, metric, accuracy FROM document_evaluations WHERE brand = 1 ORDER BY ts DESC, event_id LIMIT 15", "event_id metric ~accuracy"),
    "tuning_events": oracle("jobs", "SELECT job_id, status FROM jobs WHERE status = 'completed' ORDER BY created_at DESC, job_id LIMIT 25 OFFSET 10", "job_id status"),
    "experiments_newest": oracle("jobs", "SELECT job_id, brand, priority FROM jobs WHERE brand = 3 AND status = 'pending' ORDER BY created_at DESC, job_id LIMIT 30", "job_id brand priority"),
    "evaluations_page": oracle("document_evaluations", "SELECT event_id, metric, accuracy FROM document_evaluations ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40", "event_id metric ~accuracy"),
    "article_accuracy": oracle("accuracies", "SELECT * FROM accuracies", "doc_id article_id ~title ~body ~contributors ~media ~weighted"),
    "accuracy_report": oracle("accuracies", "SELECT * FROM report", _REPORT),
    "accuracy_json": oracle("accuracies", "SELECT doc_id, CAST(json_object('doc_id', doc_id, " + ", ".join(f"'{f}', json_object('correct', {f}_correct, 'total', {f}_total)" for f in A.WEIGHTS) + ") AS VARCHAR) AS json FROM report", "doc_id json"),
    "article_structure": oracle("structures", "SELECT *, errors = 0 AS valid FROM checked", "id errors warnings valid"),
    "dataset_quality": oracle("parameters", "SELECT avg(CASE WHEN l_tax > 0 THEN l_tax * 10 END) AS quality, avg(l_linenumber % 4) AS errors_per_file, avg(l_suppkey % 3) AS warnings_per_file, count(*) FILTER (l_linenumber % 4 = 0) AS error_free, count(*) FILTER (l_suppkey % 3 = 0) AS warning_free FROM lineitem", "~quality ~errors_per_file ~warnings_per_file error_free warning_free"),
    "annotation_consistency": "SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag <> 'A' THEN l_returnflag ELSE 'unknown' END AS type, count(*) AS blocks, count(*) FILTER (l_partkey % 4 IN (1, 2)) AS confidence_issues FROM lineitem GROUP BY 1, 2",
    "document_ocr_quality": oracle(
        "parameters",
        "SELECT *, greatest(0, (1 - mean) * 0.1::DOUBLE) AS wer, greatest(0, (1 - mean) * 0.1::DOUBLE) <= CASE WHEN dig THEN 0.001::DOUBLE ELSE 0.02::DOUBLE END AS meets_target, mean > 0.9::DOUBLE AS sure FROM (SELECT l_orderkey AS doc_id, sum((1 - l_discount * 0.9173::DOUBLE) * (CAST(l_quantity AS BIGINT) * (l_orderkey % 4))) / nullif(sum(CAST(l_quantity AS BIGINT) * (l_orderkey % 4)), 0) AS mean, min(1 - l_discount * 0.9173::DOUBLE) AS least, max(1 - l_discount * 0.9173::DOUBLE) AS most, bool_and(l_orderkey % 2 = 0) AS dig FROM lineitem GROUP BY 1)",
        "doc_id ~mean ~least ~most CASE_WER meets_target sure",
    ).replace("CASE_WER", "CASE WHEN mean IS NULL THEN 0.0::DOUBLE ELSE round(wer, 6) + 0.0::DOUBLE END AS wer"),
    "role_statistics": oracle("parameters", "SELECT l_returnflag AS role, count(*) AS matches, avg(1 - 4 * l_discount) AS mean, avg(CASE WHEN 1 - 4 * l_discount >= 0.7::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sure_rate FROM lineitem GROUP BY 1", "role matches ~mean ~sure_rate"),
    "layout_accuracy": oracle(
        "blocks sure",
        "SELECT doc_id, avg(confidence) AS mean, stddev_pop(confidence) AS spread, min(confidence) AS least, max(confidence) AS most, median(confidence) AS middle, avg(CASE WHEN confidence >= 0.95::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sure_rate, count(*) FILTER (confidence < 0.8::DOUBLE) AS unsure, least(0.999::DOUBLE, 0.8::DOUBLE + 0.2::DOUBLE * avg(CASE WHEN confidence >= 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS estimated FROM sure GROUP BY 1",
        "doc_id ~mean ~spread ~least ~most ~middle ~sure_rate unsure ~estimated",
    ),
    "compared_methods": oracle("parameters", "SELECT id, count(*) AS methods, min_by(method, (wer, method)) AS best_method, min(wer) AS best_wer, min(wer) > 0.05::DOUBLE AS preprocess, var_pop(wer) > 0.01::DOUBLE AS ensemble FROM (SELECT l_orderkey AS id, 'm' || l_linenumber AS method, CAST(round(l_tax * 100) AS BIGINT) * (l_partkey % 9) / 103.0::DOUBLE AS wer FROM lineitem) GROUP BY id", "id methods best_method ~best_wer preprocess ensemble"),
    "understanding": oracle("nodes", "SELECT b.*, coalesce(e, 0) AS edges, coalesce(e, 0) / blocks AS density FROM (SELECT doc_id, count(*) AS blocks, avg(confidence) AS confidence, count(DISTINCT type) AS types, 1.0::DOUBLE AS told FROM nodes GROUP BY 1) b LEFT JOIN (SELECT doc_id, count(*) AS e FROM edges GROUP BY 1) USING (doc_id)", "doc_id blocks ~confidence types ~told edges ~density"),
    "rolling_limits": oracle("jobs", f"SELECT brand, runs, runs < 1 AS allowed, CASE WHEN runs >= 1 THEN strftime(last + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END AS next_allowed FROM (SELECT brand, count(*) FILTER (created_at > TIMESTAMP '{_AS_OF}' - INTERVAL 1 DAY AND created_at <= TIMESTAMP '{_AS_OF}') AS runs, max(created_at) FILTER (created_at > TIMESTAMP '{_AS_OF}' - INTERVAL 1 DAY AND created_at <= TIMESTAMP '{_AS_OF}') AS last FROM jobs GROUP BY 1)", "brand runs allowed next_allowed"),
    "named_continuations": oracle("starts", "SELECT doc_id, node, text <> '' AND type <> '' AND (" + " OR ".join(f"contains(lower(text || CASE WHEN node % 3 = 0 THEN ' Continued on page 4' ELSE '' END), '{p}')" for p in T.CONTINUATION_PHRASES) + ") AS named FROM starts", "doc_id node named"),
    "ocr_block_types": oracle("blocks", f"SELECT CASE WHEN length(text) < 100 THEN CASE WHEN {_CREDIT} THEN 'attribution' WHEN len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) <= 10 THEN 'title' ELSE 'heading' END WHEN {_CAPTIONED} THEN 'caption' ELSE 'paragraph' END AS type, count(*) AS blocks FROM blocks GROUP BY 1", "type blocks"),
    "name_formats": oracle(
        "persons",
        f"SELECT id, {_JOINED.format('prefix, given, middle, family, suffix')} AS full_name, CASE WHEN family = '' THEN {_JOINED.format('prefix, given, middle, suffix')} ELSE family || ', ' || {_JOINED.format('prefix, given, middle, suffix')} END AS last_first, CASE WHEN family <> '' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM persons",
        "id full_name last_first ~confidence",
    ),
    "window_significance": oracle(
        "document_evaluations",
        "SELECT *, 1 - 2 / pi() * (theta + sin(theta) * (cos(theta) + 2 / 3 * pow(cos(theta), 3) + 8 / 15 * pow(cos(theta), 5) + 16 / 35 * pow(cos(theta), 7))) AS p_value, 1 - 2 / pi() * (theta + sin(theta) * (cos(theta) + 2 / 3 * pow(cos(theta), 3) + 8 / 15 * pow(cos(theta), 5) + 16 / 35 * pow(cos(theta), 7))) < 0.05::DOUBLE AS significant, mean - 2.2621571627409915::DOUBLE * error AS low, mean + 2.2621571627409915::DOUBLE * error AS high "
        f"FROM (SELECT *, {_THETA} AS theta FROM (SELECT *, (mean - current) / error AS t_stat FROM (SELECT metric, count(*) AS samples, avg(accuracy) AS mean, stddev_samp(accuracy) / sqrt(count(*)) AS error, max(CASE WHEN rn = 1 THEN accuracy END) AS current FROM "
        "(SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS rn, max(ts) OVER (PARTITION BY metric) AS newest FROM document_evaluations) WHERE rn <= 10 AND ts >= newest - INTERVAL 7 DAY GROUP BY metric)))",
        "metric samples ~mean ~t_stat ~p_value significant ~low ~high",
    ),
}
