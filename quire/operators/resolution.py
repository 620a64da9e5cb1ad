"""Ambiguities resolved: connection candidates, competing paths, conflict groups of captions, duplicate articles, overlaps."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import graphs
from quire.operators.folds import folded
from quire.operators.layout import page_pairs


def semantic_similarity(kind_a: Column, text_a: Column, kind_b: Column, text_b: Column) -> Column:
    """.4 compatible types, .3 an open end, .2 ratio of lengths, .1 shared words."""
    n, m = F.size(T.words(text_a)), F.size(T.words(text_b))
    ratio = F.when((n > 0) & (m > 0), F.least(n, m) / F.greatest(n, m)).otherwise(0.0)
    score = F.when(graphs.compatible(kind_a, kind_b), 0.4).otherwise(0.0) + F.when(T.suggests_continuation(text_a, text_b), 0.3).otherwise(0.0) + 0.2 * ratio + 0.1 * T.word_jaccard(text_a, text_b)
    return F.least(F.lit(1.0), score)


def best_connection(candidates: DataFrame, margin: float = 0.1) -> DataFrame:
    """candidates(doc_id, src, dst, score, page_gap, edge_type): the best target per source; within the margin, the first three are
    told apart by page and edge type."""
    by = Window.partitionBy("doc_id", "src")
    rows = candidates.withColumn("rn", F.row_number().over(by.orderBy(F.desc("score"), "dst"))).filter("rn <= 3")
    rows = rows.withColumn("close", F.max(F.when(F.col("rn") == 1, F.col("score"))).over(by) - F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("score"))).over(by), F.lit(-1.0)) < margin)
    gap, kind = F.col("page_gap"), F.col("edge_type")
    bonus = F.when(gap == 1, 0.15).when(gap == 0, 0.1).when(gap > 2, -0.1).otherwise(0.0) + F.when(kind == "follows", 0.05).when(kind == "continues_on", 0.1).otherwise(0.0)
    rows = rows.withColumn("final", F.col("score") + F.when(F.col("close"), bonus).otherwise(0.0))
    best = rows.groupBy("doc_id", "src").agg(F.max(F.struct("final", (-F.col("dst")).alias("m"))).alias("b"))
    return best.select("doc_id", "src", (-F.col("b.m")).alias("dst"), F.col("b.final").alias("score"))


def best_path(paths: DataFrame) -> DataFrame:
    """paths(doc_id, conflict, path_id, score): the winner of each conflict."""
    return paths.groupBy("doc_id", "conflict").agg(F.max(F.struct("score", (-F.col("path_id")).alias("m"))).alias("b")).select("doc_id", "conflict", (-F.col("b.m")).alias("path_id"), F.col("b.score").alias("score"))


def follow_continuations(markers: DataFrame, nodes: DataFrame) -> DataFrame:
    """markers(doc_id, src, page, target) to the first likely node of the target page (the next page where none is named)."""
    at = markers.select("doc_id", "src", F.coalesce("target", F.col("page") + 1).alias("page"))
    likely = nodes.filter(is_likely_continuation(F.col("type"), F.col("text"), F.col("y0"), F.col("confidence")))
    return at.join(likely, ["doc_id", "page"]).groupBy("doc_id", "src").agg(F.min("node").alias("dst"))


def is_likely_continuation(kind: Column, text: Column, y0: Column, confidence: Column) -> Column:
    low = F.lower(text)
    named = low.contains("continued from") | low.contains("cont. from") | low.contains("from page")
    plain = ~T.has_title_case(text) & F.when(y0 < 100, low.contains("continued")).otherwise(True)
    return graphs.is_component(kind, confidence, text) & kind.isin("body", "heading", "subtitle") & (named | plain)


def conflict_groups(matches: DataFrame) -> DataFrame:
    """matches(image_id, caption_id) with the group that shared images or captions put them in."""
    ids = matches.select(F.xxhash64(F.lit("i"), "image_id").alias("src"), F.xxhash64(F.lit("c"), "caption_id").alias("dst"), "*")
    found = graphs.components(ids.select("src", "dst"))
    return ids.join(found, ids.src == found.node).select(*matches.columns, F.col("component").alias("conflict"))


def resolve(matches: DataFrame, least: float = 0.85) -> DataFrame:
    """matches(doc_id, image_id, caption_id, confidence, spatial, semantic): one-to-one pairs per document by the first strategy that
    settles anything: confidence, then spatial quality (by layout where counts agree), then semantic strength."""

    def greedy(group: list[tuple], k: int, by: str, floor: float) -> list[tuple]:
        images: set = set()
        captions: set = set()
        out = []
        for x in sorted((x for x in group if x[k] is not None and x[k] >= floor), key=lambda x: -x[k]):
            if x[1] not in images and x[2] not in captions:
                images.add(x[1])
                captions.add(x[2])
                out.append((*x[:3], by))
        return out

    def settle(group: list[tuple]) -> list[tuple]:
        found = greedy(group, 3, "confidence", least)
        if not found:
            alike = len({x[1] for x in group} - {None}) == len({x[2] for x in group} - {None})
            found = greedy(group, 4, "spatial", 0.0 if alike else 0.5) or greedy(group, 5, "semantic", 0.5)
        return found

    rows = matches.select("doc_id", "image_id", "caption_id", *(F.col(c).cast("double").alias(c) for c in ("confidence", "spatial", "semantic")))
    return folded(rows, ["doc_id"], [F.asc_nulls_last("image_id"), F.asc_nulls_last("caption_id")], settle, "doc_id long, image_id string, caption_id string, strategy string")


def pair_quality(spatial: Column, confidence: Column, keywords: Column) -> Column:
    return 0.4 * spatial + 0.4 * confidence + 0.2 * F.least(F.lit(1.0), 0.2 * keywords)


def unique_articles(articles: DataFrame, share: float = 0.7) -> DataFrame:
    """articles(doc_id, article, title, nodes): drops an article that has the title of an earlier one or most of its nodes."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for x in pdf.sort_values("article").itertuples(index=False):
            mine = set(x.nodes)
            same = lambda y, t=x.title.lower().strip(), m=mine: y.title.lower().strip() == t or len(m & set(y.nodes)) > share * len(m | set(y.nodes))
            if not any(same(y) for y in kept):
                kept.append(x)
        return pd.DataFrame([(x.doc_id, x.article) for x in kept], columns=["doc_id", "article"])

    return articles.groupBy("doc_id").applyInPandas(keep, "doc_id long, article long")


def range_overlaps(articles: DataFrame) -> DataFrame:
    """articles(doc_id, article_id, first_page, last_page): all pairs of a document whose closed ranges meet."""
    a, b = (articles.select("doc_id", *(F.col(c).alias(f"{p}_{c}") for c in ("article_id", "first_page", "last_page"))) for p in "ab")
    meet = (F.col("a_first_page") <= F.col("b_last_page")) & (F.col("b_first_page") <= F.col("a_last_page"))
    return a.join(b, "doc_id").filter((F.col("a_article_id") < F.col("b_article_id")) & meet).select("doc_id", "a_article_id", "b_article_id")


def element_overlaps(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks of a page whose boxes share area."""
    rows = blocks.select("doc_id", "page", "line_no", "x0", "y0", "x1", "y1")
    pairs = page_pairs(rows, rows).filter("a_line_no < b_line_no").filter(G.overlaps(G.side("a"), G.side("b")))
    return pairs.select("doc_id", "page", F.col("a_line_no").alias("src"), F.col("b_line_no").alias("dst"), G.iou(G.side("a"), G.side("b")).alias("iou"))


def spread(blocks: DataFrame, gap: float = 5.0) -> DataFrame:
    """Blocks moved down, from the top, until none overlaps one before it."""

    def shift(group: list[tuple]) -> list[tuple]:
        placed: list[tuple] = []
        ends: list[float] = []
        for doc, page, line, x0, y0, x1, y1 in group:
            for y in placed[bisect_right(ends, y0) :]:
                if x0 < y[5] and y[3] < x1 and y0 < y[6] and y[4] < y1:
                    y1 += y[6] + gap - y0
                    y0 = y[6] + gap
            k = bisect_right(ends, y1)
            ends.insert(k, y1)
            placed.insert(k, (doc, page, line, x0, y0, x1, y1))
        return placed

    rows = blocks.select("doc_id", "page", "line_no", "x0", "y0", "x1", "y1")
    return folded(rows, ["doc_id", "page"], [F.asc_nulls_last(c) for c in ("y0", "x0", "line_no")], shift, "doc_id long, page int, line_no int, x0 double, y0 double, x1 double, y1 double")


def grouped_bodies(blocks: DataFrame, distance: float = 20.0) -> DataFrame:
    """Pairs of neighbouring bodies of a page that lie close, greedily from the top, at most two to a group: doc_id, page, line_no,
    group. In a chain of close neighbours every second block joins the one before it."""

    on_page = Window.partitionBy("doc_id", "page")
    down = on_page.orderBy("y0", "x0", "line_no")
    rows = blocks.select("doc_id", "page", "line_no", "x0", "y0", "x1", "y1", "type")
    before = lambda c: F.lag(c).over(down)
    near = (before("type") == "body") & (F.col("type") == "body") & (F.greatest(F.lit(0.0), F.col("y0") - before("y1")) <= distance) & (before("x0") < F.col("x1")) & (F.col("x0") < before("x1"))
    rows = rows.select("doc_id", "page", "line_no", F.row_number().over(down).alias("n"), before("line_no").alias("other"), F.coalesce(near, F.lit(False)).alias("near"), "y0", "x0")
    start = F.max(F.when(~F.col("near"), F.col("n"))).over(down.rowsBetween(Window.unboundedPreceding, 0))
    second = (F.col("n") - start) % 2 == 1
    return rows.select("doc_id", "page", "line_no", F.when(second, F.col("other")).otherwise(F.col("line_no")).alias("group"))


def layout_pattern(matches: DataFrame) -> DataFrame:
    """matches(conflict, image_id, caption_id): how each conflict group is to be settled by its counts of images and captions."""
    counts = matches.groupBy("conflict").agg(F.count_distinct("image_id").alias("images"), F.count_distinct("caption_id").alias("captions"))
    i, c = F.col("images"), F.col("captions")
    pattern = F.when((i > 1) & (c == 1), "shared_caption").when((i == 1) & (c > 1), "multiple_captions").when((i > 2) & (c > 1), "gallery").otherwise("confidence")
    return counts.withColumn("pattern", pattern)
