"""Findings of round 3: the byline, and folds in order against the rules written out row by row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import jobs as J
from quire.operators import layout as L
from quire.operators import resolution as Z
from quire.sources import markup as X

BLOCK = "doc_id long, page int, line_no int, x0 double, y0 double, x1 double, y1 double, type string, font_size double, is_bold boolean, text string"


@pytest.fixture
def small_batches(spark):
    """Arrow batches that end within groups."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _blocks(spark, seed: int):
    """Blocks that overlap, touch and tie, and a page of a single one."""
    r = random.Random(seed)
    box = lambda x, y: (float(x), float(y), float(x + r.choice((20, 60))), float(y + r.choice((5, 15, 40))))
    rows = [(d, p, n, *box(r.choice((0, 30, 50)), r.randrange(0, 200, 10)), r.choice(("body", "body", "body", "title")), r.choice((9.0, 10.0, 14.0)), r.random() < 0.2, r.choice(("", "a", "b ", "c\n"))) for d in range(6) for p in range(3) for n in range(14)]
    rows.append((9, 0, 0, 0.0, 0.0, 1.0, 1.0, "body", 9.0, False, "x"))
    pages: dict = {}
    for x in rows:
        pages.setdefault(x[:2], []).append(x)
    return spark.createDataFrame(rows, BLOCK).repartition(5), {k: sorted(v, key=lambda x: (x[4], x[3], x[2])) for k, v in pages.items()}


def _pairs(spark):
    """Matches with equal scores, a document that only the spatial and one that only the semantic strategy settles."""
    r = random.Random(3)
    rows = [(d, f"i{i}", str(c), (0.0, 0.5, 0.3)[d % 3] + r.randrange(0, 6) / 10, (0.9, 0.6, 0.1)[d % 3] * r.randrange(3, 6) / 5, r.randrange(3, 9) / 10) for d in range(12) for i in range(4) for c in range(3 + d % 2) if r.random() < 0.8]
    return spark.createDataFrame(rows, "doc_id long, image_id string, caption_id string, confidence double, spatial double, semantic double").repartition(5), rows


def _greedy(rows, k: int, floor: float) -> list[tuple]:
    out: list = []
    for x in sorted((x for x in rows if x[k] >= floor), key=lambda x: (-x[k], x[1], x[2])):
        if all(x[1] != y[1] and x[2] != y[2] for y in out):
            out.append(x)
    return out


def test_only_the_opening_paragraph_is_a_byline(spark):
    none = F.expr("cast(array() as array<struct<name: string, role: string>>)")
    xml = X.article_xml(F.lit("T"), none, F.array(F.lit("By Tom Fox"), F.lit("By and by it rained"), F.lit("x")))
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("<r>"), xml, X.article_xml(F.lit("U"), none, F.array(F.lit("x"), F.lit("By noon"))), F.lit("</r>")).alias("xml"))
    found = {r.title: [c.name for c in r.contributors] for r in X.articles_from_xml(docs).collect()}
    assert found == {"T": ["Tom Fox"], "U": []}


def test_resolved_captions_without_a_frame_per_document(spark, small_batches):
    matches, rows = _pairs(spark)
    out = Z.resolve(matches)
    expected = set()
    for d in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == d]
        spatial = 0.0 if len({x[1] for x in mine}) == len({x[2] for x in mine}) else 0.5
        for by, k, floor in (("confidence", 3, 0.85), ("spatial", 4, spatial), ("semantic", 5, 0.5)):
            if found := _greedy(mine, k, floor):
                expected |= {(*x[:3], by) for x in found}
                break
    assert {x[3] for x in expected} == {"confidence", "spatial", "semantic"}
    assert sorted(tuple(r) for r in out.collect()) == sorted(expected)
    assert "FlatMapGroups" not in _plan(out)


def test_spread_without_a_frame_per_page(spark, small_batches):
    blocks, pages = _blocks(spark, 1)
    expected = []
    for page in pages.values():
        placed: list = []
        for x in ([*x[:7]] for x in page):
            for y in sorted(placed, key=lambda y: y[6]):
                if x[3] < y[5] and y[3] < x[5] and x[4] < y[6] and y[4] < x[6]:
                    x[6] += y[6] + 5.0 - x[4]
                    x[4] = y[6] + 5.0
            placed.append(x)
        expected += map(tuple, placed)
    out = Z.spread(blocks)
    assert sorted(tuple(r) for r in out.collect()) == sorted(expected)
    assert "FlatMapGroups" not in _plan(out)


def test_next_stages_by_one_aggregate(spark):
    rows = [
        (1, "ingestion", "completed", 0), (1, "ingestion", "completed", 0), (2, "ingestion", "failed", 2), (2, "ocr", "completed", 0), (2, "layout_analysis", "completed", 9), (2, "image_extraction", "failed", 3),
        (3, "ingestion", "completed", 1), (3, "preprocessing", "failed", None), (4, "ingestion", "completed", 0), (4, "preprocessing", "in_progress", 0), (5, "unknown", "completed", 0), (6, None, None, None),
        (7, "evaluation", "completed", 0), (7, "article_reconstruction", "completed", 0), (7, "contributor_parsing", "completed", 0), (None, "ingestion", "completed", 0),
    ]
    out = J.next_stages(spark.createDataFrame(rows, "job_id long, stage string, status string, attempts int"))
    plan = _plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "preprocessing"), (2, "article_reconstruction"), (3, "preprocessing"), (7, "completed")]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_grouped_bodies_by_windows(spark):
    blocks, pages = _blocks(spark, 2)
    expected, pairs = [], 0
    for rows in pages.values():
        k = 0
        while k < len(rows):
            x, y = rows[k], rows[k + 1] if k + 1 < len(rows) else None
            near = y is not None and x[7] == y[7] == "body" and max(0.0, y[4] - x[6]) <= 20.0 and x[3] < y[5] and y[3] < x[5]
            expected += [(*z[:3], x[2]) for z in ((x, y) if near else (x,))]
            k += 2 if near else 1
            pairs += near
    out = Z.grouped_bodies(blocks)
    assert pairs > 20 and sorted(tuple(r) for r in out.collect()) == sorted(expected)
    assert "Pandas" not in _plan(out) and "Arrow" not in _plan(out)


def test_merged_blocks_without_a_frame_per_page(spark, small_batches):
    blocks, pages = _blocks(spark, 4)
    expected = []
    for rows in pages.values():
        out: list = []
        for _, _, n, x0, y0, x1, y1, _, font, bold, text in rows:
            y = out[-1] if out else None
            if y and abs(y["font"] - font) <= 2 and y["bold"] == bold:
                a, b, c, d = y["box"]
                dx, dy = max(0.0, x0 - c, a - x1), max(0.0, y0 - d, b - y1)
                low, thin = min(y1 - y0, d - b), min(x1 - x0, c - a)
                if (dx * dx + dy * dy) ** 0.5 <= 20 and (min(y1, d) - max(y0, b) > 0.5 * low or min(x1, c) - max(x0, a) > 0.5 * thin):
                    between = "" if y["text"].endswith((" ", "\n")) else " " if abs((y0 + y1) - (b + d)) / 2 < 0.5 * low else "\n"
                    y.update(text=y["text"] + between + text, box=(min(x0, a), min(y0, b), max(x1, c), max(y1, d)), merged=y["merged"] + 1)
                    continue
            out.append({"line": n, "font": font, "bold": bold, "box": (x0, y0, x1, y1), "merged": 1, "text": text})
        expected += [(*rows[0][:2], y["line"], *y["box"], y["merged"], y["text"]) for y in out]
    found = L.merge_nearby(blocks)
    assert len(expected) < 200 and sorted(tuple(r) for r in found.collect()) == sorted(expected)
    assert "FlatMapGroups" not in _plan(found)


def test_greedy_pairs_without_a_frame_per_document(spark, small_batches):
    matches, rows = _pairs(spark)
    out = L.greedy_pairs(matches.withColumn("line_no", F.col("caption_id").cast("int")))
    expected = [(x[0], x[1], int(x[2]), x[3]) for d in {x[0] for x in rows} for x in _greedy([x for x in rows if x[0] == d], 3, 0.5)]
    assert sorted(tuple(r) for r in out.collect()) == sorted(expected)
    assert "FlatMapGroups" not in _plan(out)
