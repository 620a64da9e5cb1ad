"""Registered queries of the evaluation analytics, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import evaluation as E
from quire.plans.shape import oracle, shaped
from quire.sources import standins as S

WEIGHTED = "0.0 + title * 0.3::DOUBLE + body * 0.4::DOUBLE + contributors * 0.2::DOUBLE + media * 0.1::DOUBLE"


def _results(spark, d):
    """Benchmark scores: brand by nation, component by key, score from the balance."""
    return S.table(spark, d, "supplier").select((F.col("s_nationkey") % 4).cast("int").alias("brand"), F.concat(F.lit("component_"), F.col("s_suppkey") % 4).alias("component"), ((F.col("s_acctbal") + 1000) / 110).alias("score"))


RESULTS = "results AS (SELECT CAST(s_nationkey % 4 AS INTEGER) AS brand, 'component_' || CAST(s_suppkey % 4 AS VARCHAR) AS component, (s_acctbal + 1000) / 110 AS score FROM supplier)"
S.SQL["results"] = RESULTS
S.SQL["runs"] = "runs AS (SELECT brand, status, (6 - priority) / 10.0::DOUBLE - 0.1::DOUBLE AS gain FROM jobs)"
S.SQL["detections"] = (
    "medians AS (SELECT metric, median(accuracy) AS baseline FROM document_evaluations GROUP BY metric), detections AS (SELECT metric, event_id, ts, baseline - accuracy AS accuracy_drop, baseline - accuracy >= 0.05::DOUBLE AS drift, "
    "baseline - accuracy >= 0.10::DOUBLE AS alert, baseline - accuracy >= 0.15::DOUBLE AS auto_tune FROM document_evaluations JOIN medians USING (metric))"
)


def _experiments(spark, d):
    return S.table(spark, d, "supplier").select(F.col("s_nationkey").alias("brand"), F.col("s_suppkey").alias("experiment_id"), ((F.col("s_acctbal") + 1000) / 11000).alias("accuracy"))


def _votes(spark, d):
    """Three voters on each label: the stored quality, and two rules on its id."""
    rows = S.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), "quality", "toxic")
    voters = F.array(*[F.struct(F.lit(k).alias("voter"), v.cast("int").alias("label"), F.lit(c).alias("confidence")) for k, v, c in ((0, F.col("quality"), 0.9), (1, F.col("item_id") % 3 != 0, 0.7), (2, F.col("toxic") == 0, 0.6))])
    return rows.select("item_id", F.explode(voters).alias("v")).select("item_id", "v.*")


VOTES = "votes AS (SELECT doc_id AS item_id, 0 AS voter, quality AS label, 0.9::DOUBLE AS confidence FROM labels UNION ALL SELECT doc_id, 1, CAST(doc_id % 3 <> 0 AS INTEGER), 0.7::DOUBLE FROM labels UNION ALL SELECT doc_id, 2, CAST(toxic = 0 AS INTEGER), 0.6::DOUBLE FROM labels)"
S.SQL["votes"] = VOTES

QUERIES = {
    "weighted_article": lambda s, d: shaped(S.article_evaluations(s, d).select("doc_id", "article_id", E.weighted_accuracy().alias("accuracy"))),
    "document_rollup": lambda s, d: shaped(E.document_accuracy(S.article_evaluations(s, d))),
    "field_accuracy": lambda s, d: shaped(E.field_accuracy(S.article_evaluations(s, d))),
    "run_averages": lambda s, d: shaped(E.run_averages(S.article_evaluations(s, d))),
    "system_health": lambda s, d: shaped(E.system_health(S.document_evaluations(s, d), S.article_evaluations(s, d))),
    "drift_report": lambda s, d: shaped(E.drift_report(S.document_evaluations(s, d))),
    "drift_status": lambda s, d: E.drift_status(E.drift_detections(S.document_evaluations(s, d))),
    "drift_summary": lambda s, d: shaped(E.drift_summary(E.drift_detections(S.document_evaluations(s, d)))),
    "accuracy_trend": lambda s, d: shaped(E.accuracy_trend(S.document_evaluations(s, d))),
    "accuracy_history": lambda s, d: shaped(E.accuracy_history(S.document_evaluations(s, d), "purchase", 14, 1)),
    "latest_evaluations": lambda s, d: shaped(E.latest(S.document_evaluations(s, d), 20, F.desc("ts"), F.desc("event_id")).select("event_id", "metric", "accuracy")),
    "metrics_percentiles": lambda s, d: shaped(E.percentiles(S.document_evaluations(s, d))),
    "benchmark_overall": lambda s, d: shaped(E.benchmark_overall(_results(s, d))),
    "benchmark_levels": lambda s, d: shaped(E.benchmark_levels(_results(s, d))),
    "benchmark_all_brands": lambda s, d: shaped(E.all_brands(_results(s, d))),
    "best_model_per_brand": lambda s, d: shaped(E.best_per_brand(_experiments(s, d))),
    "failure_patterns": lambda s, d: shaped(E.failure_patterns(S.article_evaluations(s, d))),
    "holdout_accuracy": lambda s, d: shaped(E.holdout_accuracy(S.article_evaluations(s, d))),
    "baseline_of_runs": lambda s, d: shaped(E.baseline_of_runs(S.document_evaluations(s, d))),
    "tuning_statistics": lambda s, d: shaped(E.tuning_statistics(S.jobs(s, d).select("brand", "status", ((6 - F.col("priority")) / 10.0 - 0.1).alias("gain")))),
    "tuning_grid": lambda s, d: E.parameter_grid(s, {"threshold": [0.5, 0.6, 0.7, 0.8], "weight": [0.1, 0.2, 0.3, 0.4], "margin": [0.0, 0.1, 0.2, 0.3]}),
    "tuning_search": lambda s, d: shaped(E.search(_experiments(s, d).filter("brand = 3").select(F.col("experiment_id").alias("rank"), F.col("accuracy").alias("score")), 0.1)),
    "precision_recall": lambda s, d: shaped(E.precision_recall(S.table(s, d, "labels").select((F.col("doc_id") % 5 != 0).alias("predicted"), (F.col("quality") == 1).alias("actual")))),
    "threshold_checks": lambda s, d: shaped(E.threshold_checks(S.document_evaluations(s, d).groupBy("metric").agg(F.avg("accuracy").alias("score")), {"click": 0.9, "error": 0.95, "purchase": 0.8, "view": 0.85})),
    "difficulty_distribution": lambda s, d: E.difficulty_distribution(S.document_evaluations(s, d).select((1 - F.col("accuracy")).alias("difficulty"))),
    "ensemble_vote": lambda s, d: shaped(E.ensemble_vote(_votes(s, d))),
    "confidence_histogram": lambda s, d: E.confidence_histogram(S.document_evaluations(s, d).select(F.col("accuracy").alias("confidence"))),
    "confidence_uniformity": lambda s, d: shaped(E.confidence_uniformity(S.document_evaluations(s, d).select(F.col("metric").alias("group"), F.col("accuracy").alias("confidence")))),
}

_FIELDS = ("title", "body", "contributors", "media")
_BEST_EARLIER = "coalesce(earlier, average)"

ORACLE_SQL = {
    "weighted_article": oracle("article_evaluations", f"SELECT doc_id, article_id, {WEIGHTED} AS accuracy FROM article_evaluations", "doc_id article_id ~accuracy"),
    "document_rollup": oracle("article_evaluations", f"SELECT doc_id, avg({WEIGHTED}) AS accuracy, count(*) AS articles FROM article_evaluations GROUP BY doc_id", "doc_id ~accuracy articles"),
    "field_accuracy": oracle(
        "article_evaluations",
        " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} >= 0.9::DOUBLE) AS correct, count(*) AS total, count(*) FILTER (WHERE {c} >= 0.9::DOUBLE) / greatest(1, count(*))::DOUBLE AS accuracy FROM article_evaluations" for c in _FIELDS),
        "field correct total ~accuracy",
    ),
    "run_averages": oracle(
        "article_evaluations",
        f"SELECT brand, count(*) AS documents, count(*) FILTER (WHERE overall >= 0.5) AS successful, {', '.join(f'coalesce(sum({c}) FILTER (WHERE overall >= 0.5), 0) / greatest(1, count(*) FILTER (WHERE overall >= 0.5)) AS avg_{c}' for c in ('overall', *_FIELDS))} "
        f"FROM (SELECT brand, doc_id, avg({WEIGHTED}) AS overall, {', '.join(f'avg({c}) AS {c}' for c in _FIELDS)} FROM article_evaluations GROUP BY brand, doc_id) GROUP BY brand",
        "brand documents successful ~avg_overall ~avg_title ~avg_body ~avg_contributors ~avg_media",
    ),
    "system_health": oracle(
        "document_evaluations article_evaluations",
        "SELECT count(*) AS documents_processed, CAST(coalesce(sum(articles), 0) AS BIGINT) AS articles_processed, count(*) FILTER (WHERE accuracy >= 0.5) / greatest(1, count(*))::DOUBLE AS success_rate, coalesce(avg(accuracy) FILTER (WHERE accuracy >= 0.5), 0) AS average_accuracy, "
        "count(*) FILTER (WHERE accuracy < 0.2::DOUBLE) AS drift_alerts FROM (SELECT * FROM document_evaluations WHERE ts >= (SELECT max(ts) FROM document_evaluations) - INTERVAL 24 HOUR) e LEFT JOIN (SELECT doc_id, count(*) AS articles FROM article_evaluations GROUP BY doc_id) a ON e.event_id = a.doc_id",
        "documents_processed articles_processed ~success_rate ~average_accuracy drift_alerts",
    ),
    "drift_report": oracle(
        "document_evaluations",
        "SELECT metric, samples, current, baseline, baseline - current AS accuracy_drop, samples >= 5 AND baseline - current >= 0.05::DOUBLE AS drift, samples >= 5 AND baseline - current >= 0.10::DOUBLE AS alert, samples >= 5 AND baseline - current >= 0.15::DOUBLE AS auto_tune, "
        "CASE WHEN spread > 0 THEN (mean - current) / (spread / sqrt(samples)) END AS t_stat, slope, CASE WHEN samples < 3 THEN 'insufficient_data' WHEN abs(slope) < 0.001::DOUBLE THEN 'stable' WHEN slope > 0 THEN 'improving' ELSE 'declining' END AS trend FROM ("
        "SELECT metric, max(accuracy) FILTER (WHERE rn = 1) AS current, count(*) AS samples, avg(accuracy) AS mean, stddev_samp(accuracy) AS spread, regr_slope(accuracy, rn) AS slope FROM ("
        "SELECT e.*, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS rn FROM document_evaluations e JOIN (SELECT metric, max(ts) AS newest FROM document_evaluations GROUP BY metric) n USING (metric) WHERE ts >= newest - INTERVAL 7 DAY) WHERE rn <= 10 GROUP BY metric) w "
        "JOIN (SELECT metric, median(accuracy) AS baseline FROM document_evaluations WHERE ts >= (SELECT max(ts) FROM document_evaluations) - INTERVAL 30 DAY GROUP BY metric) b USING (metric)",
        "metric samples ~current ~baseline ~accuracy_drop drift alert auto_tune ~t_stat ~slope trend",
    ),
    "drift_status": oracle(
        "document_evaluations detections",
        "SELECT metric, event_id, CASE WHEN auto_tune THEN 'auto_tuning_triggered' WHEN alert THEN 'alert_triggered' WHEN drift THEN 'drift_detected' ELSE 'no_drift' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS rn FROM detections) WHERE rn = 1",
        "metric event_id status",
    ),
    "drift_summary": oracle(
        "document_evaluations detections",
        "SELECT count(*) AS total_detections, count(*) FILTER (WHERE drift) AS drift_count, count(*) FILTER (WHERE alert) AS alert_count, count(*) FILTER (WHERE auto_tune) AS auto_tune_count, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics_affected, coalesce(avg(accuracy_drop), 0) AS average_drop "
        "FROM detections WHERE ts >= (SELECT max(ts) FROM detections) - INTERVAL 7 DAY",
        "total_detections drift_count alert_count auto_tune_count metrics_affected ~average_drop",
    ),
    "accuracy_trend": oracle(
        "document_evaluations",
        f"SELECT *, CASE WHEN recent > {_BEST_EARLIER} + 0.01::DOUBLE THEN 'improving' WHEN recent < {_BEST_EARLIER} - 0.01::DOUBLE THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT metric, max(accuracy) FILTER (WHERE rn = 1) AS current, avg(accuracy) AS average, min(accuracy) AS least, max(accuracy) AS most, "
        "avg(accuracy) FILTER (WHERE rn <= 7) AS recent, avg(accuracy) FILTER (WHERE rn > 7) AS earlier FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS rn FROM document_evaluations) GROUP BY metric)",
        "metric ~current ~average ~least ~most ~recent ~earlier trend",
    ),
    "accuracy_history": oracle(
        "document_evaluations",
        "SELECT event_id, brand, accuracy FROM document_evaluations WHERE metric = 'purchase' AND brand = 1 AND ts >= (SELECT max(ts) FROM document_evaluations WHERE metric = 'purchase' AND brand = 1) - INTERVAL 14 DAY",
        "event_id brand ~accuracy",
    ),
    "latest_evaluations": oracle("document_evaluations", "SELECT event_id, metric, accuracy FROM document_evaluations ORDER BY ts DESC, event_id DESC LIMIT 20", "event_id metric ~accuracy"),
    "metrics_percentiles": oracle(
        "document_evaluations", "SELECT metric, " + ", ".join(f"quantile_cont(accuracy, {p}) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + ", stddev_pop(accuracy) AS spread FROM document_evaluations GROUP BY metric", "metric ~p25 ~p50 ~p75 ~p90 ~p95 ~p99 ~spread"
    ),
    "benchmark_overall": oracle(
        "results", "SELECT brand, avg(score) AS average_score, median(score) AS median_score, count(*) FILTER (WHERE score >= 90) / count(*)::DOUBLE * 100 AS production_rate, count(DISTINCT component) AS coverage, count(*) AS metrics FROM results GROUP BY brand", "brand ~average_score ~median_score ~production_rate coverage metrics"
    ),
    "benchmark_levels": oracle(
        "results",
        "SELECT component, count(*) FILTER (WHERE score >= 90) AS production, count(*) FILTER (WHERE score >= 75 AND score < 90) AS acceptable, count(*) FILTER (WHERE score >= 50 AND score < 75) AS needs_improvement, count(*) FILTER (WHERE score < 50) AS failing, max(score) AS best_score, bool_or(score >= 90) AS production_ready FROM results GROUP BY component",
        "component production acceptable needs_improvement failing ~best_score production_ready",
    ),
    "benchmark_all_brands": oracle("results", "SELECT brand, count(*) AS metrics, avg(score) AS average_score, avg(CASE WHEN score >= 90 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ready_share FROM results GROUP BY ROLLUP (brand)", "brand metrics ~average_score ~ready_share"),
    "best_model_per_brand": oracle(
        "results",
        "SELECT s_nationkey AS brand, count(*) AS experiments, max((s_acctbal + 1000) / 11000) AS best_accuracy, min(s_suppkey) FILTER (WHERE rn = 1) AS best_id FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier) GROUP BY s_nationkey",
        "brand experiments ~best_accuracy best_id",
    ),
    "failure_patterns": oracle(
        "article_evaluations",
        f"SELECT field, avg(1 - accuracy) AS severity, count(*) AS frequency, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE rn <= 5) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY doc_id) AS rn FROM ({' UNION ALL '.join(f'''SELECT doc_id, '{c}' AS field, avg({c}) AS accuracy FROM article_evaluations GROUP BY doc_id HAVING avg({c}) < 0.8::DOUBLE''' for c in _FIELDS)})) GROUP BY field HAVING count(*) >= 2",
        "field ~severity frequency examples",
    ),
    "holdout_accuracy": oracle(
        "article_evaluations", f"SELECT coalesce(avg(accuracy), 0) AS holdout_accuracy, count(*) AS held FROM (SELECT {WEIGHTED} AS accuracy FROM article_evaluations WHERE {WEIGHTED} >= 0.6::DOUBLE ORDER BY ts DESC, doc_id, article_id LIMIT 50)", "~holdout_accuracy held"
    ),
    "baseline_of_runs": oracle("document_evaluations", "SELECT brand, avg(accuracy) AS baseline FROM document_evaluations WHERE ts >= (SELECT max(ts) FROM document_evaluations) - INTERVAL 30 DAY GROUP BY brand", "brand ~baseline"),
    "tuning_statistics": oracle("jobs runs", "SELECT count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'running') AS running, avg(gain) FILTER (WHERE status = 'completed') AS average_gain, count(DISTINCT brand) AS brands FROM runs", "runs completed running ~average_gain brands"),
    "tuning_grid": "SELECT CAST(row_number() OVER (ORDER BY a.i, b.i, c.i) AS INTEGER) AS rank, a.v AS threshold, b.v AS weight, c.v AS margin FROM (VALUES (0, 0.5::DOUBLE), (1, 0.6::DOUBLE), (2, 0.7::DOUBLE), (3, 0.8::DOUBLE)) a(i, v), (VALUES (0, 0.1::DOUBLE), (1, 0.2::DOUBLE), (2, 0.3::DOUBLE), (3, 0.4::DOUBLE)) b(i, v), (VALUES (0, 0.0::DOUBLE), (1, 0.1::DOUBLE), (2, 0.2::DOUBLE), (3, 0.3::DOUBLE)) c(i, v) ORDER BY rank LIMIT 50",
    "tuning_search": oracle(
        "results",
        "SELECT rank, score, best_before FROM (SELECT *, coalesce(sum(CASE WHEN score - best_before > 0.02::DOUBLE THEN 1 ELSE 0 END) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM (SELECT s_suppkey AS rank, (s_acctbal + 1000) / 11000 AS score, greatest(0.1::DOUBLE, coalesce(max((s_acctbal + 1000) / 11000) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.1::DOUBLE)) AS best_before FROM supplier WHERE s_nationkey = 3)) WHERE stopped = 0",
        "rank ~score ~best_before",
    ),
    "precision_recall": oracle(
        "results",
        "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, recall / 0.99::DOUBLE AS achievement FROM (SELECT *, CASE WHEN made > 0 THEN correct / made::DOUBLE ELSE 0 END AS precision, CASE WHEN attempted > 0 THEN correct / attempted::DOUBLE ELSE 0 END AS recall FROM (SELECT count(*) FILTER (WHERE doc_id % 5 <> 0 AND quality = 1) AS correct, count(*) FILTER (WHERE doc_id % 5 <> 0) AS made, count(*) AS attempted FROM labels))",
        "correct made attempted ~precision ~recall ~f1 ~achievement",
    ),
    "threshold_checks": oracle(
        "document_evaluations", "SELECT metric, score, threshold, score >= threshold AS passed FROM (SELECT metric, avg(accuracy) AS score FROM document_evaluations GROUP BY metric) JOIN (VALUES ('click', 0.9::DOUBLE), ('error', 0.95::DOUBLE), ('purchase', 0.8::DOUBLE), ('view', 0.85::DOUBLE)) t(metric, threshold) USING (metric)", "metric ~score ~threshold passed"
    ),
    "difficulty_distribution": oracle("document_evaluations", "SELECT CASE WHEN 1 - accuracy < 0.2::DOUBLE THEN 'easy' WHEN 1 - accuracy < 0.5::DOUBLE THEN 'medium' WHEN 1 - accuracy < 0.8::DOUBLE THEN 'hard' ELSE 'very_hard' END AS level, count(*) AS elements FROM document_evaluations GROUP BY 1", "level elements"),
    "ensemble_vote": oracle(
        "votes",
        "SELECT item_id, label, n / voters::DOUBLE AS agreement, mean * (0.7::DOUBLE + 0.3::DOUBLE * (n / voters::DOUBLE)) AS confidence FROM (SELECT *, sum(n) OVER (PARTITION BY item_id) AS voters, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first_voter) AS rn FROM (SELECT item_id, label, count(*) AS n, avg(confidence) AS mean, min(voter) AS first_voter FROM votes GROUP BY item_id, label)) WHERE rn = 1",
        "item_id label ~agreement ~confidence",
    ),
    "confidence_histogram": oracle("document_evaluations", "SELECT CAST(least(floor(accuracy * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM document_evaluations GROUP BY 1", "bin n"),
    "confidence_uniformity": oracle(
        "document_evaluations",
        "SELECT metric AS \"group\", CASE WHEN count(*) < 2 THEN 1.0::DOUBLE WHEN avg(accuracy) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - stddev_pop(accuracy) / avg(accuracy)) END AS uniformity, avg(accuracy) AS mean, min(accuracy) AS least, max(accuracy) AS most, count(*) FILTER (WHERE accuracy >= 0.8::DOUBLE) AS reliable, count(*) FILTER (WHERE accuracy < 0.5) AS uncertain FROM document_evaluations GROUP BY metric",
        '"group" ~uniformity ~mean ~least ~most reliable uncertain',
    ),
}
