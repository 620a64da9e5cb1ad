"""Page layout: classification of text blocks, reading order, columns, spatial relations, captions.

Blocks are rows of (doc_id, page, line_no, x0, y0, x1, y1, font_size, is_bold, n_words, text), y growing downward. Pairs are formed
within a page of a document only, by an equi-join on (doc_id, page), so no pair is built across pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators.folds import folded

PAGE = ["doc_id", "page"]
HEIGHT, WIDTH, MARGIN, TITLE_SHARE = 800.0, 600.0, 50.0, 0.3


def rule_class() -> Column:
    """(type, confidence) by the layout rules; as a later rule has to be surer than the ones before it to win, and a sure one
    of high priority ends the search, the rules fall into this one order. Null where no rule fits."""
    font, n, text = F.coalesce("font_size", F.lit(-1.0)), F.col("n_words"), F.col("text")
    rules = [
        ("title", 0.9, (font >= 18) & (F.col("y0") <= 200) & (n <= 20) & F.col("is_bold")),
        ("page_number", 0.9, (n <= 3) & text.rlike(r"(?i)^\d+$|^Page\s+\d+|^\d+\s*/\s*\d+$")),
        ("header", 0.8, (F.col("y0") <= 50) & (n <= 15)),
        ("footer", 0.8, (F.col("y1") >= HEIGHT - 50) & (n <= 15)),
        ("byline", 0.8, (n <= 10) & text.rlike(r"(?i)^By\s+|^\w+\s+\w+\s+reports?|^Author:")),
        ("caption", 0.7, (font > 0) & (font <= 10) & (n <= 50)),
        ("heading", 0.7, (font >= 14) & (n <= 15)),
        ("body", 0.6, n >= 5),
    ]
    out = F.lit(None).cast("struct<type: string, confidence: double>")
    for kind, sure, test in reversed(rules):
        out = F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def heuristic_class() -> Column:
    """(type, confidence) of a block that no rule fits."""
    text, font, n = F.trim("text"), F.coalesce("font_size", F.lit(0.0)), F.col("n_words")
    cascade = [
        ("page_number", 0.8, T.is_page_number(text)), ("header", 0.7, (F.col("y0") < MARGIN) & ~T.is_content(text)), ("footer", 0.7, (F.col("y1") > HEIGHT - MARGIN) & ~T.is_content(text)),
        ("title", 0.6, (F.col("y0") < HEIGHT * TITLE_SHARE) & (font > 16) & (n <= 15)), ("byline", 0.7, T.is_byline(text)), ("caption", 0.6, T.is_caption(text, F.col("font_size"))), ("quote", 0.6, T.is_quote(text)),
        ("advertisement", 0.7, T.is_advertisement(text)), ("heading", 0.5, (font > 12) & (n <= 20)), ("body", 0.4, n >= 10),
    ]
    out = F.struct(F.lit("unknown").alias("type"), F.lit(0.0).alias("confidence"))
    for kind, sure, test in reversed(cascade):
        out = F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def classify(blocks: DataFrame) -> DataFrame:
    """blocks with type and confidence: the rules, and the heuristics where these are no surer than 0.5."""
    found = blocks.withColumn("c", F.coalesce(rule_class(), heuristic_class()))
    return found.select(*blocks.columns, F.col("c.type").alias("type"), F.col("c.confidence").alias("confidence"))


def one_title(classified: DataFrame) -> DataFrame:
    """One title per page, the surest and largest; others become headings at 0.8. Bodies below five words become captions or
    headings at 0.9."""
    best = Window.partitionBy(*PAGE, "type").orderBy(F.desc("confidence"), F.desc("font_size"), "line_no")
    ranked = classified.withColumn("rn", F.row_number().over(best))
    lesser, short = (F.col("type") == "title") & (F.col("rn") > 1), (F.col("type") == "body") & (F.col("n_words") < 5)
    kind = F.when(lesser, "heading").when(short & (F.col("font_size") < 10), "caption").when(short, "heading").otherwise(F.col("type"))
    sure = F.col("confidence") * F.when(lesser, 0.8).when(short, 0.9).otherwise(1.0)
    return ranked.withColumns({"new_type": kind, "new_confidence": sure}).drop("rn", "type", "confidence").withColumnsRenamed({"new_type": "type", "new_confidence": "confidence"})


def simple_class() -> Column:
    """The short fallback: numbers, short large lines, bylines, small print, else body."""
    low, n = F.lower(F.trim("text")), F.col("n_words")
    return F.when(low.rlike(r"^(?:page\s*)?\d+$"), "page_number").when((n <= 10) & (F.col("font_size") > 14), "title").when(low.startswith("by ") | low.contains("correspondent"), "byline").when(F.col("font_size") < 10, "caption").otherwise("body")


def type_by_font(font: Column, bold: Column) -> Column:
    return F.when(font >= 18, "title").when((font >= 14) | bold, "heading").when(font < 9, "footnote").otherwise("paragraph")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Rank of each block on its page, from the top and the left."""
    return blocks.withColumn("reading_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_no")) - 1)


def columns(blocks: DataFrame) -> DataFrame:
    """Column of each block: a gap of over a tenth of the page between neighbouring centres begins a new one."""
    rows = blocks.withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    by = Window.partitionBy(*PAGE).orderBy("cx")
    start = F.coalesce((F.col("cx") - F.lag("cx").over(by) > WIDTH * 0.1).cast("int"), F.lit(0))
    rows = rows.withColumn("start", start)
    return rows.withColumn("column", (1 + F.sum("start").over(by.rangeBetween(Window.unboundedPreceding, 0))).cast("int")).drop("start")


def page_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rows on the same page, their columns prefixed a_ and b_."""
    left = a.select(*PAGE, *(F.col(c).alias(f"a_{c}") for c in a.columns if c not in PAGE))
    right = b.select(*PAGE, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in PAGE))
    return left.join(right, PAGE)


def spatial_edges(blocks: DataFrame) -> DataFrame:
    """Relations of blocks on a page at most NEAR apart: doc_id, page, src, dst, relation, confidence; pairs once, in order."""
    rows = blocks.select(*PAGE, "line_no", "x0", "y0", "x1", "y1")
    pairs = page_pairs(rows, rows).filter("a_line_no < b_line_no")
    a, b = G.side("a"), G.side("b")
    h, v = G.horizontal_gap(a, b), G.vertical_gap(a, b)
    edge = lambda test, kind, sure: F.when(test, F.struct(F.lit(kind).alias("relation"), sure.alias("confidence")))
    stacked, level = G.spatial_confidence(v, h), G.spatial_confidence(h, v)
    edges = F.array_compact(F.array(
        edge((h <= G.NEAR) & (a.y1 < b.y0), "above", stacked), edge((h <= G.NEAR) & (b.y1 < a.y0), "below", stacked), edge((v <= G.NEAR) & (a.x1 < b.x0), "left_of", level), edge((v <= G.NEAR) & (b.x1 < a.x0), "right_of", level),
    ))
    return pairs.select(*PAGE, F.col("a_line_no").alias("src"), F.col("b_line_no").alias("dst"), F.explode(edges).alias("e")).select(*PAGE, "src", "dst", "e.relation", "e.confidence")


def is_caption_candidate(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for word in T.CAPTION_WORDS:
        out = out | low.contains(word)
    return out & F.size(T.words(text)).between(2, 100)


def caption_candidates(images: DataFrame, blocks: DataFrame, reach: float = 500.0) -> DataFrame:
    """Images with the text blocks of their page within reach, with scores, nearest first."""
    texts = blocks.filter(F.col("n_words").between(2, 100)).select(*PAGE, "line_no", "x0", "y0", "x1", "y1")
    pairs = page_pairs(images, texts)
    image, caption = G.side("a"), G.side("b")
    distance = G.centre_distance(image, caption)
    kind = G.match_type(image, caption)
    out = pairs.filter(distance <= reach).select(
        "doc_id", F.col("a_image_id").alias("image_id"), F.col("b_line_no").alias("line_no"), distance.alias("distance"), G.proximity_score(image, caption).alias("proximity"), kind.alias("match_type"), G.layout_confidence(kind).alias("layout")
    )
    nearest = Window.partitionBy("image_id").orderBy("distance", "line_no")
    return out.withColumn("rank", F.row_number().over(nearest)).withColumn("competitors", (F.count("*").over(Window.partitionBy("image_id")) - 1))


def match_confidence(candidates: DataFrame) -> DataFrame:
    """Overall confidence .4 spatial, .25 semantic (low, as no keywords are given), .2 layout, .15 uniqueness by competitors."""
    n = F.col("competitors")
    unique = F.when(n == 0, 1.0).when(n <= 2, 0.8).when(n <= 5, 0.6).otherwise(0.4)
    ambiguity = F.least(F.lit(1.0), n / 10)
    overall = (0.4 * F.col("proximity") + 0.25 * 0.3 + 0.2 * F.col("layout") + 0.15 * unique) * (1 - 0.3 * ambiguity)
    return candidates.withColumn("confidence", overall)


def best_caption(candidates: DataFrame) -> DataFrame:
    return candidates.filter("rank = 1").select("doc_id", "image_id", "line_no", "distance")


def greedy_pairs(candidates: DataFrame, least: float = 0.5, by: str = "confidence") -> DataFrame:
    """One-to-one image and caption pairs per document, surest first; a document's candidates are few (its own blocks)."""

    def assign(group: list[tuple]) -> list[tuple]:
        images: set = set()
        lines: set = set()
        out = []
        for x in group:
            if x[1] not in images and x[2] not in lines:
                images.add(x[1])
                lines.add(x[2])
                out.append(x)
        return out

    rows = candidates.select("doc_id", "image_id", "line_no", F.col(by).alias("confidence")).filter((F.col("confidence") >= least) & ~F.isnan("confidence"))
    return folded(rows, ["doc_id"], [F.desc("confidence"), F.asc_nulls_last("image_id"), F.asc_nulls_last("line_no")], assign, "doc_id long, image_id string, line_no int, confidence double")


def unique_filenames(names: DataFrame, name: str = "filename") -> DataFrame:
    """Numbers repeated names: the first keeps its own, later ones get _01, _02 before the extension."""
    rn = F.row_number().over(Window.partitionBy(name).orderBy("image_id")) - 1
    base, ext = F.regexp_extract(name, r"^(.*?)(?:\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return names.withColumn("rn", rn).withColumn("unique_name", F.when(F.col("rn") == 0, F.col(name)).otherwise(F.concat(base, F.format_string("_%02d", F.col("rn")), ext))).drop("rn")


def merge_nearby(blocks: DataFrame, distance: float = 20.0) -> DataFrame:
    """Folds the blocks of a page, top to bottom, into the block before them where fonts agree and they lie close and aligned."""

    def merge(group: list[tuple]) -> list[tuple]:
        out: list[list] = []
        for doc, page, line, x0, y0, x1, y1, font, bold, text in group:
            y = out[-1] if out else None
            if y and abs(y[7] - font) <= 2 and y[8] == bold:
                _, _, _, u0, v0, u1, v1, _, _, tail, pieces, _ = y
                dx, dy = max(0.0, x0 - u1, u0 - x1), max(0.0, y0 - v1, v0 - y1)
                wide, high = min(x1, u1) - max(x0, u0), min(y1, v1) - max(y0, v0)
                level, upright = high > 0.5 * min(y1 - y0, v1 - v0), wide > 0.5 * min(x1 - x0, u1 - u0)
                if (dx * dx + dy * dy) ** 0.5 <= distance and (level or upright):
                    same_line = abs((y0 + y1) - (v0 + v1)) / 2 < 0.5 * min(y1 - y0, v1 - v0)
                    between = "" if tail.endswith((" ", "\n")) else " " if same_line else "\n"
                    pieces += (between, text)
                    y[3:7] = min(x0, u0), min(y0, v0), max(x1, u1), max(y1, v1)
                    y[9], y[11] = text or between or tail, y[11] + 1
                    continue
            out.append([doc, page, line, x0, y0, x1, y1, font, bold, text, [text], 1])
        return [(*y[:7], y[11], "".join(y[10])) for y in out]

    rows = blocks.select(*PAGE, "line_no", "x0", "y0", "x1", "y1", "font_size", "is_bold", "text")
    return folded(rows, PAGE, [F.asc_nulls_last(c) for c in ("y0", "x0", "line_no")], merge, "doc_id long, page int, line_no int, x0 double, y0 double, x1 double, y1 double, merged int, text string")


def readable(blocks: DataFrame, least: float = 0.5, length: int = 3) -> DataFrame:
    """Blocks sure and long enough that hold a letter or digit."""
    return blocks.filter((F.col("confidence") >= least) & (F.length(F.trim("text")) >= length) & F.col("text").rlike(r"[\p{L}\p{N}]"))


def fallback_class() -> Column:
    """(type, confidence) where a model is unsure: number, short large line, byline, small print, long text."""
    low, n = F.lower(F.trim("text")), F.col("n_words")
    pick = lambda kind, sure: F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
    return (
        F.when(low.rlike(r"^(?:page\s*)?\d+$"), pick("page_number", 0.8)).when((n <= 10) & (F.col("font_size") > 14), pick("title", 0.7)).when(low.startswith("by ") | low.contains("correspondent"), pick("byline", 0.7))
        .when(F.col("font_size") < 10, pick("caption", 0.6)).when(n >= 10, pick("body", 0.5)).otherwise(pick("unknown", 0.0))
    )


def numbered_images(images: DataFrame) -> DataFrame:
    """Sequence numbers of a document's images by page, from the top and the left, as file names."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "image_id"))
    return images.select("doc_id", "image_id", n.alias("sequence"), F.format_string("image_%03d.jpg", n).alias("filename"))
