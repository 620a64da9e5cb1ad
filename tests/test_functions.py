"""Column expressions and sequence metrics on small cases with known answers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import sequences as Q
from quire.functions import text as T


def value(spark, column, **inputs):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items()), F.lit(0).alias("_"))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "expected"), [
    ("Café  DR. Smith's  Self-Made!", "cafe doctor smith's self-made"), ("Prof. Ms Mr", "professor miss mister"), ("", ""), (None, ""),
])
def test_normalised_title(spark, text, expected):
    assert value(spark, T.normalised_title(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(("text", "expected"), [("  jane o'neil  JR", "Jane O'Neil Jr."), ("dr josé", "Dr. Jose"), ("", "")])
def test_normalised_name(spark, text, expected):
    assert value(spark, T.normalised_name(F.lit(text))) == expected


@pytest.mark.parametrize(("test", "yes", "no"), [
    (T.is_page_number, ["12", "Page 3", "3 / 10", "xiv"], ["Page", "twelve", "mmmmmmmm"]), (T.is_byline, ["by jane doe", "Our correspondent in Rome", "Author: jane"], ["by 3 o'clock", "standby me"]),
    (T.is_quote, ['"so it goes"', "'x'", 'she said "no"'], ["plain"]), (T.is_advertisement, ["Subscribe today", "see www.x.org"], ["plain"]), (T.is_content, ["he said so", "word " * 21], ["short"]),
    (T.is_person_name, ["Jane Doe", "Anne-Marie O'Neil"], ["jane doe", "Jane", "Staff Writer"]), (T.has_title_case, ["The Art of War", "A Tale of Two Cities"], ["the art of war", "Word"]),
])
def test_predicates(spark, test, yes, no):
    frame = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "t string, expected boolean")
    assert all(r.x == r.expected for r in frame.select(test(F.col("t")).alias("x"), "expected").collect())


@pytest.mark.parametrize(("name", "expected"), [("economist_2024-03-05.pdf", ("economist", "2024-03-05")), ("x/time_magazine 20240305", ("time", "2024-03-05")), ("wired/03-05-2024.pdf", ("wired", "2024-03-05")), ("misc 3-5-2024", (None, "2024-03-05")), ("vogue_2024-13-05", ("vogue", None))])
def test_brand_and_date(spark, name, expected):
    assert (value(spark, T.brand(F.lit(name))), value(spark, T.issue_date(F.lit(name)))) == expected


def test_continuation_markers(spark):
    found = value(spark, T.continuation_markers(F.lit("Story Continued on page 12. (cont.) and see page 4")))
    assert {(m.type, m.target) for m in found} >= {("forward", 12), ("jump", 4), ("forward", None)} and all(0.5 <= m.confidence <= 1 for m in found)


def test_caption_keywords(spark):
    found = value(spark, T.caption_keywords(F.lit("Photo by Jane Doe: a picture")))
    assert {"photo_credit", "photo_photo", "photo_picture", "credit_by", "name_jane_doe"} <= set(found)
    assert value(spark, T.semantic_confidence(T.caption_keywords(F.lit("nothing")), F.lit("nothing"))) == 0.3


@pytest.mark.parametrize(("text", "given", "family", "suffix"), [("Jane Q. Doe", "Jane", "Doe", ""), ("Doe, Jane", "Jane", "Doe", ""), ("By Dr. John Smith, Jr.", "John", "Smith", "Jr"), ("Cher", "", "Cher", "")])
def test_person_name(spark, text, given, family, suffix):
    n = value(spark, T.person_name(F.lit(text)))
    assert (n.given, n.family, n.suffix) == (given, family, suffix)


def box(*at):
    return G.Box(*map(F.lit, map(float, at)))


def test_geometry(spark):
    a, b = box(0, 0, 10, 10), box(5, 5, 15, 15)
    assert value(spark, G.iou(a, b)) == pytest.approx(25 / 175) and value(spark, G.iou(a, box(10, 0, 20, 10))) == 0
    assert value(spark, G.horizontal_gap(a, box(30, 0, 40, 10))) == 20 and value(spark, G.vertical_gap(a, b)) == 0
    assert value(spark, G.centre_distance(a, b)) == pytest.approx(50**0.5)
    image = box(100, 100, 200, 200)
    for caption, kind in ((box(100, 210, 200, 230), "direct_below"), (box(100, 70, 200, 95), "direct_above"), (box(210, 110, 300, 190), "side_by_side"), (box(120, 120, 150, 140), "embedded"), (box(700, 700, 800, 720), "distant")):
        assert value(spark, G.match_type(image, caption)) == kind
    assert value(spark, G.spatial_confidence(F.lit(0.0), F.lit(0.0))) == pytest.approx(0.8)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert Q.edit_distance(a, b) == row[-1]


def test_word_error_rate_and_p_values():
    assert Q.word_error_rate(["a", "b", "c", "d"], ["a", "x", "d"]) == 0.5 and Q.word_error_rate([], []) == 0 and Q.word_error_rate([], ["a"]) == 1 and Q.word_error_rate(["a"], []) == 1
    assert Q.tokens("Café — x1") == ["cafe", "x1"] or Q.tokens("Café") == ["cafe"]
    assert Q.t_two_sided(2.262157, 9) == pytest.approx(0.05, abs=1e-6) and Q.t_two_sided(0.0, 5) == 1 and Q.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
