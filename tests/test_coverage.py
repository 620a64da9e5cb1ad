"""Operators added for listings, reports, names and combined matches, against plain Python."""

from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.functions import sequences as Q
from quire.functions import text as T
from quire.operators import contributors, jobs, listings, resolution

REPO = Path(__file__).parent.parent


def test_combined_matches_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for k in range(400):
        start = rng.randrange(40)
        rows.append((rng.randrange(12), start, start + rng.randint(1, 15), rng.choice(["pattern", "ner"]), rng.choice([0.5, 0.8, 0.9]), f"n{k}"))
    expected = []
    for i in range(12):
        kept: list[tuple] = []
        for x in sorted((r for r in rows if r[0] == i), key=lambda r: (r[3] != "pattern", -r[4], r[1], r[2], r[5])):
            if not any(min(x[2], y[2]) - max(x[1], y[1]) > 0.5 * min(x[2] - x[1], y[2] - y[1]) for y in kept):
                kept.append(x)
        expected += kept
    out = contributors.combined(spark.createDataFrame(rows, "id long, start long, stop long, method string, confidence double, name string"))
    assert sorted(map(tuple, out.collect())) == sorted(expected)


@pytest.mark.parametrize(("name", "expected"), [("smith-JONES", "Smith-Jones"), ("o'brien", "O'Brien"), ("mcdonald", "McDonald"), ("macarthur", "MaCarthur"), ("mc", "Mc"), ("ÉMILE", "Émile"), ("", "")])
def test_capitals(spark, name, expected):
    assert spark.range(1).select(T.capitalised(F.lit(name))).first()[0] == expected


def test_names_in_either_order(spark):
    parts = [F.lit(x) for x in ("Dr.", "Ann", "Q.", "Li", "Jr.")]
    row = spark.range(1).select(T.full_name(*parts), T.last_first(*parts), T.last_first(F.lit(""), F.lit("Ann"), F.lit(""), F.lit(""), F.lit("")), T.initial(F.lit("q")), T.initial(F.lit("sue"))).first()
    assert tuple(row) == ("Dr. Ann Q. Li Jr.", "Li, Dr. Ann Q. Jr.", "Ann", "Q.", "sue")


def test_t_quantile():
    assert Q._quantile(0.95, 9) == pytest.approx(2.2621571627, abs=1e-6) and Q._quantile(0.99, 4) == pytest.approx(4.6040948714, abs=1e-6)


def test_rolling_limit(spark):
    runs = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-01 00:00:01'), ('a', TIMESTAMP_NTZ '2024-01-02 01:00:00'), ('b', TIMESTAMP_NTZ '2024-01-01 00:00:00') AS t(brand, created_at)")
    out = {r.brand: (r.runs, r.allowed, str(r.next_allowed)) for r in jobs.rolling_limit(runs, "2024-01-02 00:00:00").collect()}
    assert out == {"a": (1, False, "2024-01-02 00:00:01"), "b": (0, True, "None")}


def test_listing_pages(spark):
    rows = spark.range(100).selectExpr("id", "id % 3 AS kind", "id % 7 AS time")
    found = [r.id for r in listings.newest(rows, "time", "id", skip=2, size=3, kind=1).collect()]
    assert found == [x for _, x in sorted((-(k % 7), k) for k in range(100) if k % 3 == 1)][2:5]


def test_layout_patterns(spark):
    rows = [(1, "i1", "c1"), (1, "i2", "c1"), (2, "i3", "c2"), (2, "i3", "c3"), (3, "i4", "c4"), (4, "i5", "c5"), (4, "i6", "c5"), (4, "i7", "c6")]
    out = resolution.layout_pattern(spark.createDataFrame(rows, "conflict long, image_id string, caption_id string")).collect()
    assert {r.conflict: r.pattern for r in out} == {1: "shared_caption", 2: "multiple_captions", 3: "confidence", 4: "gallery"}


@pytest.mark.parametrize("left", [[], ["quire/llm/__pycache__"]])
def test_entry_without_the_training_folders(tmp_path, left):
    """A copy without the folders and the pipeline, or with a leftover cache folder, still has its library queries."""
    import shutil

    shutil.copytree(REPO / "quire", tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    for folder in left:
        (tmp_path / folder).mkdir(parents=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sum(n.startswith('op') or n == 'pipeline' for n in q if n[2:3].isdigit() or n == 'pipeline'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, oracles, training = map(int, out.stdout.split())
    assert n > 150 and oracles > 120 and training == 0
