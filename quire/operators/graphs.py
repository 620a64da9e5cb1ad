"""Semantic graph of a document: nodes (doc_id, node, page, type, confidence), edges (doc_id, src, dst, edge_type, confidence)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPATIBLE = [("title", "subtitle"), ("title", "byline"), ("subtitle", "body"), ("byline", "body"), ("body", "body"), ("heading", "body"), ("quote", "body")]


def follows(nodes: DataFrame) -> DataFrame:
    """FOLLOWS edges between consecutive nodes of a page, at 0.8."""
    after = F.lead("node").over(Window.partitionBy("doc_id", "page").orderBy("node"))
    return nodes.select("doc_id", F.col("node").alias("src"), after.alias("dst"), F.lit("follows").alias("edge_type"), F.lit(0.8).alias("confidence")).filter("dst IS NOT NULL")


def neighbours(edges: DataFrame, nodes: DataFrame, forward: bool = True) -> DataFrame:
    """Successors (or predecessors) of every node, with their types."""
    here, there = ("src", "dst") if forward else ("dst", "src")
    found = nodes.select("doc_id", F.col("node").alias(there), "type")
    return edges.join(found, ["doc_id", there]).select("doc_id", F.col(here).alias("node"), F.col(there).alias("other"), "type", "edge_type")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per document: nodes, edges, pages, mean confidences, nodes without an edge."""
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.countDistinct("page").alias("pages"), F.avg("confidence").alias("node_confidence"))
    e = edges.groupBy("doc_id").agg(F.count("*").alias("edges"), F.avg("confidence").alias("edge_confidence"))
    ends = edges.select("doc_id", F.col("src").alias("node")).union(edges.select("doc_id", "dst"))
    alone = nodes.join(ends, ["doc_id", "node"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("singletons"))
    out = n.join(e, "doc_id", "left").join(alone, "doc_id", "left")
    return out.select("doc_id", "nodes", "pages", "node_confidence", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("edge_confidence", F.lit(0.0)).alias("edge_confidence"), F.coalesce("singletons", F.lit(0)).alias("singletons"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is not a node of their document."""
    return edges.join(nodes.select("doc_id", F.col("node").alias("dst")), ["doc_id", "dst"], "left_anti")


def merged(*graphs: DataFrame, key: tuple[str, ...] = ("doc_id", "node")) -> DataFrame:
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.dropDuplicates(list(key))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of edges (src, dst) reaches, in either direction.

    Labels spread along edges, and each round also jumps to the label's own label, so long chains take few rounds; every round is
    checkpointed to the shared folder.
    """
    spark = edges.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp())
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(edges.select("dst", "src")).distinct().checkpoint()
    labels = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")).checkpoint()
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.x).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        step = step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")).checkpoint()
        labels = step.select("node", "component")
        if step.filter("old <> component").isEmpty():
            return labels


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Reading order per document along its edges; ties and cycles by node number. A document's graph is small."""

    def order(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        import heapq

        known = set(n.node)
        into = dict.fromkeys(known, 0)
        after: dict[int, list[int]] = {k: [] for k in known}
        for s, d in zip(e.src, e.dst, strict=True):
            if s in known and d in known:
                into[d] += 1
                after[s].append(d)
        heap, left, out = [k for k in known if not into[k]], set(known), []
        heapq.heapify(heap)
        while left:
            k = heapq.heappop(heap) if heap else min(left)
            if k not in left:
                continue
            left.discard(k)
            out.append(k)
            for d in after[k]:
                into[d] -= 1
                if not into[d] and d in left:
                    heapq.heappush(heap, d)
        return pd.DataFrame({"doc_id": key[0], "node": out, "position": range(len(out))})

    return nodes.select("doc_id", "node").groupBy("doc_id").cogroup(edges.select("doc_id", "src", "dst").groupBy("doc_id")).applyInPandas(order, "doc_id long, node long, position int")


def reconstruct(nodes: DataFrame, edges: DataFrame, least: float = 0.3, most: int = 200) -> DataFrame:
    """Articles of a document: starts by score, depth first along the surest edges, nodes taken once over all articles."""

    def walk(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        info = {x.node: x for x in n.itertuples()}
        after: dict[int, list[tuple[float, int]]] = {}
        for x in e[e.confidence >= least].itertuples():
            if x.edge_type in ("follows", "belongs_to", "continues_on"):
                after.setdefault(x.src, []).append((-x.confidence, x.dst))
        seen: set[int] = set()
        rows = []
        starts = sorted((x for x in info.values() if x.type in ("title", "heading") and x.confidence >= 0.7), key=lambda x: (-x.start_score, x.node))
        for number, start in enumerate(starts):
            if start.node in seen:
                continue
            stack, path = [start.node], []
            while stack and len(path) < most:
                k = stack.pop()
                if k in seen or k not in info or (k != start.node and info[k].type in ("header", "footer", "page_number", "advertisement", "title")):
                    continue
                seen.add(k)
                path.append(k)
                stack += [d for _, d in sorted(after.get(k, []), reverse=True)]
            rows += [(key[0], number, place, k) for place, k in enumerate(path)]
        return pd.DataFrame(rows, columns=["doc_id", "article", "place", "node"])

    return nodes.groupBy("doc_id").cogroup(edges.groupBy("doc_id")).applyInPandas(walk, "doc_id long, article int, place int, node long")


def start_score(kind: Column, confidence: Column, y0: Column, font: Column, n_words: Column, title_case: Column) -> Column:
    by_type = F.when(kind == "title", 0.3).when(kind == "subtitle", 0.2).when(kind == "heading", 0.1).otherwise(0.0)
    length = F.when(n_words.between(5, 12), 0.1).when(n_words.between(3, 20), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), 0.4 * confidence + by_type + 0.2 * F.greatest(F.lit(0.0), 1 - y0 / 500) + F.when(font > 16, 0.1).otherwise(0.0) + length + F.when(title_case, 0.1).otherwise(0.0))


def is_article_start(kind: Column, confidence: Column, y0: Column, font: Column, n_words: Column, title_case: Column, least: float = 0.7) -> Column:
    plain = n_words.between(3, 20) & (y0 <= 300) & (F.coalesce(font, F.lit(14.0)) >= 14) & title_case
    return F.when(kind == "title", confidence >= least).when(kind.isin("subtitle", "heading"), confidence >= 0.9).otherwise(plain)


def is_component(kind: Column, confidence: Column, text: Column, least: float = 0.3) -> Column:
    return (confidence >= least) & (F.length(F.trim(text)) >= 10) & ~kind.isin("header", "footer", "page_number", "advertisement")


def compatible(a: Column, b: Column) -> Column:
    pairs = F.array(*(F.lit(f"{x}|{y}") for p in COMPATIBLE for x, y in (p, p[::-1])))
    return F.array_contains(pairs, F.concat_ws("|", a, b))


def connection_score(confidence: Column, distance: Column, similarity: Column, continues: Column) -> Column:
    """.3 space, .4 likeness, .3 continuation; with these weights the edge's own confidence counts nothing."""
    space = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 1000))
    return 0.0 * confidence + 0.3 * space + 0.4 * similarity + 0.3 * F.when(continues, 1.0).otherwise(0.0)


def path_score(confidence: Column, length: Column, kinds: Column, pages: Column, has_title: Column, has_body: Column) -> Column:
    part = lambda x, of: F.least(F.lit(1.0), x / of)
    return (
        0.4 * confidence + 0.2 * part(length, 20) + 0.15 * part(kinds, 5) + 0.1 * part(pages, 5)
        + F.when(has_title, 0.1).otherwise(0.0) + F.when(has_body, 0.05).otherwise(0.0) + F.when(has_title & has_body, 0.1).otherwise(0.0)
    )


def article_scores(components_: DataFrame) -> DataFrame:
    """components_(doc_id, article, type, confidence, n_words): confidence, completeness and the quality gate per article."""
    n = F.count("*")
    sure = 0.4 * F.avg("confidence") + 0.4 * F.avg("confidence") + 0.2 * F.least(F.lit(1.0), n / 10)
    titled, bodies = F.bool_or(F.col("type") == "title"), F.count_if(F.col("type") == "body")
    complete = F.when(titled, 0.3).otherwise(0.0) + F.when(bodies > 0, 0.4).otherwise(0.0) + F.when(bodies > 1, 0.2).otherwise(0.0) + F.when(F.sum("n_words") >= 50, 0.1).otherwise(0.0)
    out = components_.groupBy("doc_id", "article").agg(n.alias("components"), F.sum("n_words").alias("words"), F.least(F.lit(1.0), sure).alias("confidence"), F.least(F.lit(1.0), complete).alias("completeness"), titled.alias("titled"), F.bool_or(F.col("type") == "advertisement").alias("ad"))
    return out.withColumn("accepted", (F.col("confidence") >= 0.4) & (F.col("words") >= 50) & F.col("titled") & ~F.col("ad"))


def full_text(components_: DataFrame) -> DataFrame:
    """The text of each article in order; headings stand apart, bylines end a line, paragraphs end with a blank line."""
    text = F.trim("text")
    piece = F.when(F.col("type").isin("title", "subtitle", "heading"), F.concat(F.lit("\n\n"), text, F.lit("\n"))).when(F.col("type") == "byline", F.concat(text, F.lit("\n"))).otherwise(F.concat(text, F.lit("\n\n")))
    ordered = F.array_sort(F.collect_list(F.struct("place", piece.alias("piece"))))
    return components_.filter(text != "").groupBy("doc_id", "article").agg(F.trim(F.regexp_replace(F.array_join(F.transform(ordered, lambda x: x["piece"]), ""), r"^\s+|\s+$", "")).alias("full_text"))


def nodes_of(nodes: DataFrame, kind: str | None = None, page: int | None = None) -> DataFrame:
    """The nodes of a type, of a page, or both."""
    if kind is not None:
        nodes = nodes.filter(F.col("type") == kind)
    return nodes if page is None else nodes.filter(F.col("page") == page)


def edges_of(edges: DataFrame, kind: str) -> DataFrame:
    """The edges of a type."""
    return edges.filter(F.col("edge_type") == kind)
