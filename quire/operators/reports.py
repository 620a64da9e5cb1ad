"""Reports over OCR confidences, texts, images, curation, annotation, experiments and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def confidence_levels(blocks: DataFrame, reliable: float = 0.8, uncertain: float = 0.5) -> DataFrame:
    """blocks(doc_id, page, line_no, confidence, text): figures of the confidence at block, line, word and character level.

    Lines, words and characters take their block's confidence; each level weighs a block by how many of them it has.
    """
    weights = {"block": F.lit(1), "line": F.lit(1) + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), "word": F.size(T.words(F.col("text"))), "character": F.length("text")}
    rows = blocks.select("confidence", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), w.cast("long").alias("n")) for k, w in weights.items()))).alias("l")).select("confidence", "l.*").filter("n > 0")
    n, c = F.col("n"), F.col("confidence")
    mean = F.sum(n * c) / F.sum(n)
    return rows.groupBy("level").agg(
        F.sum("n").alias("elements"), mean.alias("average"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.sqrt(F.greatest(F.lit(0.0), F.sum(n * c * c) / F.sum(n) - mean * mean)).alias("spread"),
        F.sum(F.when(c >= reliable, n).otherwise(0)).alias("reliable"), F.sum(F.when(c < uncertain, n).otherwise(0)).alias("uncertain"),
    )


def confidence_by(values: DataFrame, key: Column, name: str) -> DataFrame:
    return values.groupBy(key.alias(name)).agg(F.avg("confidence").alias("confidence"), F.count("*").alias("n"))


def confidence_by_region(blocks: DataFrame, width: float = 600.0, height: float = 800.0, cells: int = 3) -> DataFrame:
    """Mean confidence in a grid over the page, by the centre of each block."""
    cell = lambda a, b, size: F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor((F.col(a) + F.col(b)) / 2 / size * cells))).cast("int")
    return blocks.groupBy(cell("x0", "x1", width).alias("column"), cell("y0", "y1", height).alias("row")).agg(F.avg("confidence").alias("confidence"), F.count("*").alias("blocks"))


def confidence_patterns(words: DataFrame) -> DataFrame:
    """words(doc_id, confidence): share of low words, runs of low confidence are told by their neighbours in the text order `place`."""
    by = Window.partitionBy("doc_id").orderBy("place")
    low = words.withColumn("low", (F.col("confidence") < 0.5).cast("int")).withColumn("start", F.when((F.col("low") == 1) & (F.coalesce(F.lag("low").over(by), F.lit(0)) == 0), 1).otherwise(0))
    return low.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum("low").alias("low_words"), F.sum("start").alias("low_runs"), F.avg("confidence").alias("confidence"))


def page_text_summary(blocks: DataFrame) -> DataFrame:
    """Per page: blocks, words, characters, mean font size, distinct fonts, share of bold blocks."""
    return blocks.groupBy("doc_id", "page").agg(F.count("*").alias("blocks"), F.sum("n_words").alias("words"), F.sum(F.octet_length("text")).alias("bytes"), F.avg("font_size").alias("font_size"), F.countDistinct("font_size").alias("fonts"), F.avg(F.col("is_bold").cast("double")).alias("bold_share"))


def text_density(blocks: DataFrame, page_area: float = 480_000.0) -> DataFrame:
    """Share of each page that its boxes cover, overlaps counted twice."""
    return blocks.groupBy("doc_id", "page").agg((F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / page_area).alias("density"))


def image_summary(images: DataFrame) -> DataFrame:
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return images.groupBy("doc_id").agg(F.count("*").alias("images"), F.countDistinct("page").alias("pages"), F.sum(area).alias("area"), F.max(area).alias("largest"))


def document_confidence(blocks: DataFrame, penalties: int = 0) -> DataFrame:
    """Mean confidence weighted by type (title 2, heading and byline 1.5, caption and quote .8), less .05 per edge case, in [.1, 1]."""
    w = F.when(F.col("type") == "title", 2.0).when(F.col("type").isin("heading", "byline"), 1.5).when(F.col("type").isin("caption", "pullquote", "quote"), 0.8).otherwise(1.0)
    score = F.sum(w * F.col("confidence")) / F.greatest(F.lit(1.0), F.sum(w)) - min(0.2, 0.05 * penalties)
    return blocks.groupBy("doc_id").agg(F.greatest(F.lit(0.1), F.least(F.lit(1.0), score)).alias("confidence"))


def suite_summary(documents: DataFrame) -> DataFrame:
    """documents(brand, articles, pages, difficulty): totals and means with the total over all brands (brand null)."""
    return documents.rollup("brand").agg(F.count("*").alias("documents"), F.sum("articles").alias("articles"), F.sum("pages").alias("pages"), F.avg("difficulty").alias("difficulty"))


def workflow_report(tasks: DataFrame) -> DataFrame:
    """tasks(annotator, status, quality): counts per status, and the mean quality of validated ones."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "pending", "running")]
    return tasks.groupBy("annotator").agg(*counts, F.avg(F.when(F.col("status") == "completed", F.col("quality"))).alias("validated_quality"))


def key_scores(reports: DataFrame) -> DataFrame:
    """reports(scores map): mean of each key."""
    return reports.select(F.explode("scores").alias("key", "score")).groupBy("key").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def experiment_summary(experiments: DataFrame, ready: float = 0.9) -> DataFrame:
    """experiments(experiment_id, brand, accuracy): counts, ready share, best."""
    return experiments.agg(F.count("*").alias("experiments"), F.countDistinct("brand").alias("brands"), F.avg((F.col("accuracy") >= ready).cast("double")).alias("ready_share"), F.max("accuracy").alias("best"), F.max_by("experiment_id", F.struct("accuracy", -F.col("experiment_id"))).alias("best_id"))


def compared(experiments: DataFrame, ids: list[int]) -> DataFrame:
    """The chosen experiments with their distance from the best of them."""
    chosen = experiments.filter(F.col("experiment_id").isin(ids))
    return chosen.crossJoin(F.broadcast(chosen.agg(F.max("accuracy").alias("best")))).select("experiment_id", "brand", "accuracy", (F.col("best") - F.col("accuracy")).alias("behind"))


def name_statistics(names: DataFrame) -> DataFrame:
    """names(name): how many are complete, suffixed, prefixed, and the mean confidence."""
    n = names.select(T.person_name(F.col("name")).alias("n")).select("n.*")
    return n.agg(F.count("*").alias("names"), F.count_if((F.col("given") != "") & (F.col("family") != "")).alias("complete"), F.count_if(F.col("suffix") != "").alias("suffixed"), F.count_if(F.col("prefix") != "").alias("prefixed"), F.avg("confidence").alias("confidence"))


def invalid_parameters(parameters: DataFrame) -> DataFrame:
    """parameters(key, kind, value string): the errors of values that don't fit their kind."""
    number = F.col("value").try_cast("double")
    errors = F.array_compact(F.array(
        F.when(F.col("value").isNull(), "missing"), F.when(F.col("kind").isin("threshold", "weight", "number") & number.isNull() & F.col("value").isNotNull(), "not a number"), F.when(F.col("kind").isin("threshold", "weight") & ~number.between(0, 1), "outside 0 to 1"),
        F.when((F.col("kind") == "prompt") & (F.length("value") < 10), "prompt too short"), F.when((F.col("kind") == "rule") & F.get_json_object("value", "$.condition").isNull(), "rule without condition"),
    ))
    return parameters.select("key", F.array_join(errors, ";").alias("errors")).filter("errors <> ''")


def flattened(maps: DataFrame) -> DataFrame:
    """maps(category, values map) to one row per parameter, its hash beside it."""
    return maps.select("category", F.explode("values").alias("name", "value")).select(F.concat_ws(".", "category", "name").alias("key"), "value", F.sha2(F.col("value").cast("string"), 256).alias("hash"))


def hard_coded(configs: DataFrame) -> DataFrame:
    """configs(path, json): numbers inside a JSON document by their path, through the variant type."""
    query = "SELECT path, key, to_json(value) AS value FROM {configs}, LATERAL variant_explode(parse_json(json)) WHERE schema_of_variant(value) RLIKE 'BIGINT|DECIMAL|DOUBLE'"
    return configs.sparkSession.sql(query, configs=configs)


def document_ocr_quality(pages: DataFrame, digital: float = 0.001, scanned: float = 0.02) -> DataFrame:
    """pages(doc_id, page, confidence, characters, is_digital): confidence by characters, an error rate estimated from it, and whether
    that meets the document's target; documents without characters are left with nulls."""
    out = pages.groupBy("doc_id").agg(
        (F.sum(F.col("confidence") * F.col("characters")) / F.nullif(F.sum("characters"), F.lit(0))).alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.bool_and("is_digital").alias("is_digital")
    )
    rate = F.greatest(F.lit(0.0), (1 - F.col("mean")) * 0.1)
    return out.select("doc_id", "mean", "least", "most", rate.alias("wer"), (rate <= F.when(F.col("is_digital"), digital).otherwise(scanned)).alias("meets_target"), (F.col("mean") > 0.9).alias("sure"))


def role_statistics(matches: DataFrame, least: float = 0.7) -> DataFrame:
    """matches(role, confidence): matches, mean confidence and share of sure ones, per role."""
    return matches.groupBy("role").agg(F.count("*").alias("matches"), F.avg("confidence").alias("mean"), F.avg((F.col("confidence") >= least).cast("double")).alias("sure_rate"))


def layout_accuracy(blocks: DataFrame, threshold: float = 0.95) -> DataFrame:
    """blocks(doc_id, confidence): spread of a document's confidences, shares of sure ones, and the accuracy estimated from these."""
    rate = lambda test: F.avg(test.cast("double"))
    c = F.col("confidence")
    out = blocks.groupBy("doc_id").agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("spread"), F.min(c).alias("least"), F.max(c).alias("most"), F.median(c).alias("middle"), rate(c >= threshold).alias("sure_rate"),
        F.count_if(c < 0.8).alias("unsure"), F.least(F.lit(0.999), 0.8 + 0.2 * rate(c >= 0.9)).alias("estimated"),
    )
    return out


def compared_methods(results: DataFrame) -> DataFrame:
    """results(id, method, wer): per id the method of the least rate (the first by name among equals) and what to do about it."""
    best = F.min(F.struct("wer", "method"))
    out = results.groupBy("id").agg(F.count("*").alias("methods"), best.alias("b"), F.var_pop("wer").alias("spread"))
    return out.select("id", "methods", F.col("b.method").alias("best_method"), F.col("b.wer").alias("best_wer"), (F.col("b.wer") > 0.05).alias("preprocess"), (F.col("spread") > 0.01).alias("ensemble"))


def understanding(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Per document: blocks(doc_id, type, confidence) and edges(doc_id), their number, mean confidence, types told, and edges per block."""
    b = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.avg("confidence").alias("confidence"), F.count_distinct("type").alias("types"), F.avg((F.col("type") != "unknown").cast("double")).alias("told"))
    e = edges.groupBy("doc_id").agg(F.count("*").alias("edges"))
    out = b.join(e, "doc_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return out.withColumn("density", F.col("edges") / F.col("blocks"))
