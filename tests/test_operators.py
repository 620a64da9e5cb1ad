"""Order-dependent and iterative operators, markup round trips and streams."""

from __future__ import annotations

import datetime
import importlib
import sys

from pyspark.sql import functions as F

from quire.operators import contributors as C
from quire.operators import graphs as G
from quire.operators import jobs as J
from quire.operators import layout as L
from quire.operators import matching as M
from quire.operators import parameters as P
from quire.operators import validation as V
from quire.sources import markup as X
from quire.streaming import drift as D


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (105, 101)], "src long, dst long")
    out = {r.node: r.component for r in G.components(edges).collect()}
    assert {out[k] for k in range(1, 41)} == {1} and {out[k] for k in (100, 101, 105)} == {100}


def test_topological_order_with_a_cycle(spark):
    nodes = spark.createDataFrame([(1, k) for k in range(5)], "doc_id long, node long")
    edges = spark.createDataFrame([(1, 3, 0), (1, 0, 1), (1, 2, 4), (1, 4, 2)], "doc_id long, src long, dst long")
    order = [r.node for r in G.topological_order(nodes, edges).orderBy("position").collect()]
    assert order.index(3) < order.index(0) < order.index(1) and sorted(order) == list(range(5))


def test_reconstruction_takes_nodes_once(spark):
    nodes = spark.createDataFrame([(1, 0, "title", 0.9, 0.9), (1, 1, "body", 0.9, 0.0), (1, 2, "header", 0.9, 0.0), (1, 3, "title", 0.9, 0.8), (1, 4, "body", 0.9, 0.0)], "doc_id long, node long, type string, confidence double, start_score double")
    edges = spark.createDataFrame([(1, 0, 1, "follows", 0.8), (1, 1, 2, "follows", 0.8), (1, 3, 1, "follows", 0.9), (1, 3, 4, "follows", 0.8), (1, 0, 4, "follows", 0.1)], "doc_id long, src long, dst long, edge_type string, confidence double")
    out = {(r.article, r.place): r.node for r in G.reconstruct(nodes, edges).collect()}
    assert out == {(0, 0): 0, (0, 1): 1, (1, 0): 3, (1, 1): 4}


def test_greedy_pairs(spark):
    rows = [(1, "a", 1, 0.9), (1, "a", 2, 0.8), (1, "b", 1, 0.85), (1, "b", 2, 0.7), (1, "c", 3, 0.3)]
    out = {(r.image_id, r.line_no) for r in L.greedy_pairs(spark.createDataFrame(rows, "doc_id long, image_id string, line_no int, confidence double")).collect()}
    assert out == {("a", 1), ("b", 2)}


def test_merge_nearby(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 100.0, 20.0, 10.0, False, "one"), (1, 0, 1, 0.0, 25.0, 100.0, 45.0, 10.0, False, "two"), (1, 0, 2, 0.0, 300.0, 100.0, 320.0, 10.0, False, "far"), (1, 0, 3, 0.0, 322.0, 100.0, 340.0, 18.0, False, "big")]
    out = L.merge_nearby(spark.createDataFrame(rows, "doc_id long, page int, line_no int, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean, text string")).orderBy("y0").collect()
    assert [(r.text, r.merged) for r in out] == [("one\ntwo", 2), ("far", 1), ("big", 1)]


def test_unique_filenames(spark):
    out = L.unique_filenames(spark.createDataFrame([("1", "a.jpg"), ("2", "a.jpg"), ("3", "b")], "image_id string, filename string")).orderBy("image_id").collect()
    assert [r.unique_name for r in out] == ["a.jpg", "a_01.jpg", "b"]


def test_contributors(spark):
    texts = spark.createDataFrame([(1, "By Jane Doe"), (2, "Photo by Tom Fox"), (3, "Getty Images"), (4, "Ann Lee, staff writer"), (5, None)], "id long, text string")
    by = {(r.id, r.name) for r in C.matches(texts, C.BYLINES).collect()}
    assert (1, "Jane Doe") in by and (4, "Ann Lee") in by and not any(k in (3, 5) for k, _ in by)
    assert {(r.id, r.name) for r in C.matches(texts, C.CREDITS, credit=True).collect()} == {(2, "Tom Fox")}
    people = spark.createDataFrame([(1, "Jane Doe", 0.8), (1, "Jane", 0.9), (1, "Tom Fox", 0.5)], "id long, name string, confidence double")
    assert {(r.name, r.confidence) for r in C.deduplicate_names(people).collect()} == {("Jane", 0.9), ("Tom Fox", 0.5)}
    spans = spark.createDataFrame([(1, 0, 10, 0.5, 1), (1, 5, 12, 0.9, 2), (1, 20, 30, 0.4, 3)], "id long, start long, stop long, confidence double, label long")
    assert {r.label for r in C.deduplicate_spans(spans).collect()} == {2, 3}
    roles = {r.id: r.r.role for r in texts.filter("text IS NOT NULL").select("id", C.classify_role(F.col("text")).alias("r")).collect()}
    assert roles[2] == "photographer" and roles[3] == "unknown"


def test_matched_articles_and_media(spark):
    truth = spark.createDataFrame([(1, 10, "A Long Story"), (1, 11, "Other News Today"), (1, 12, "Missing")], "doc_id long, article_id long, title string")
    found = spark.createDataFrame([(1, 10, "x"), (1, 50, "Other news today!"), (1, 51, "zzz")], "doc_id long, article_id long, title string")
    assert {r.article_id: r.found_id for r in M.matched_articles(truth, found).collect()} == {10: 10, 11: 50, 12: None}
    image = "doc_id long, page int, image_id string, x0 double, y0 double, x1 double, y1 double, caption string"
    images = spark.createDataFrame([(1, 0, "i", 0.0, 0.0, 10.0, 10.0, "A cat"), (1, 0, "j", 50.0, 50.0, 60.0, 60.0, None)], image)
    media = spark.createDataFrame([(1, 0, "m", 0.0, 0.0, 10.0, 10.0, "a cat")], image)
    r = M.media_accuracy(images, media).first()
    assert (r.correct, r.total) == (1, 2)


def test_parameters_and_jobs(spark):
    at = datetime.datetime
    parameters = spark.createDataFrame([("a", "c", 1.0), ("b", "c", 2.0), ("d", "c", 3.0)], "key string, category string, default_value double")
    versions = spark.createDataFrame([("a", 1, 4, 5.0, "active", at(2024, 1, 1)), ("a", 2, 5, 6.0, "draft", at(2024, 2, 1)), ("b", 1, 1, 7.0, "active", at(2024, 1, 1))], "key string, run long, patch int, value double, status string, created_at timestamp_ntz")
    overrides = spark.createDataFrame([("b", 1, 1, 1, 5.0, 8.0, at(2024, 1, 1), None), ("b", 2, 1, 1, 9.0, 9.0, at(2024, 1, 1), at(2024, 1, 2))], "key string, run long, patch int, brand int, priority double, value double, valid_from timestamp_ntz, valid_until timestamp_ntz")
    out = {r.key: (r.value, r.origin) for r in P.effective(parameters, versions, overrides, "2024-03-01 00:00:00", 1).collect()}
    assert out == {"a": (5.0, "version"), "b": (8.0, "override"), "d": (3.0, "default")}
    assert {r.key: r.next_version for r in P.next_version(versions, parameters).collect()} == {"a": "1.0.6", "b": "1.0.2", "d": "1.0.0"}
    steps = spark.createDataFrame([(1, "ingestion", "completed", 1), (1, "preprocessing", "failed", 3), (2, "ingestion", "completed", 1), (2, "preprocessing", "failed", 1)], "job_id long, stage string, status string, attempts int")
    assert {(r.job_id, r.stage) for r in J.next_stages(steps).collect()} == {(2, "preprocessing")}


def test_validation(spark):
    blocks = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id long, block_id string")
    r = V.integrity(blocks, spark.createDataFrame([(1, "a"), (1, "zz")], "doc_id long, block_id string")).first()
    assert (r.duplicates, r.dangling, r.unreferenced, r.passed) == (1, 1, 1, False) and abs(r.score - 0.9) < 1e-9


def test_markup(spark):
    people = F.array(F.struct(F.lit("A & B").alias("name"), F.lit("editor").alias("role")))
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("<r>"), X.article_xml(F.lit("T < 1"), people, F.array(F.lit("By Tom Fox"), F.lit("x & y"))), F.lit("</r>")).alias("xml"))
    r = X.articles_from_xml(docs).first()
    assert r.title == "T < 1" and [(c.name, c.role) for c in r.contributors] == [("A & B", "editor"), ("Tom Fox", "author")] and r.text.endswith("x & y")
    good, bad = X.strict(spark.createDataFrame([(1, "<r><a>1</a></r>"), (2, "<r><a>x</r>")], "doc_id long, xml string"), "a int")
    assert [r.doc_id for r in good.collect()] == [1] and [r.doc_id for r in bad.collect()] == [2]


def test_files(spark, tmp_path):
    for name, content in (("a.xml", "1"), ("b.xml", "1"), ("c.json", "2")):
        (tmp_path / name).write_text(content)
    assert {r.name for r in X.files(spark, str(tmp_path)).collect()} == {"a.xml", "c.json"}


def test_streams(spark, tmp_path):
    rows = [(k, "m", datetime.datetime(2024, 1, 1, k // 6, k % 6 * 10), 0.9 if k < 20 else 0.6) for k in range(30)]
    schema = "event_id long, metric string, ts timestamp_ntz, accuracy double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = D.drift_stream(source()).writeStream.format("memory").queryName("drift").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    query.awaitTermination(120)
    r = spark.table("drift").collect()[-1]
    assert r.samples == 10 and abs(r.accuracy_drop - 0.3) < 1e-9 and r.auto_tune
    query = D.windowed_accuracy(source()).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    query.awaitTermination(120)
    assert all(r.n == 6 for r in spark.table("windows").collect()) and spark.table("windows").count() >= 1


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"%PDF-1.7 x"), ("c.pdf", b"junk")):
        (tmp_path / "in" / name).write_bytes(content)
    kept: dict[str, list] = {"good": [], "bad": []}
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(f"{tmp_path}/in")
    D.start_ingest(files, lambda df, n: kept["good"].extend(df.select("path").collect()), lambda df, n: kept["bad"].extend(df.select("path").collect()), f"{tmp_path}/check").awaitTermination(120)
    assert len(kept["good"]) == 1 and len(kept["bad"]) == 1


def test_entry_works_without_training_data(monkeypatch):
    for name in ("quire.llm", "quire.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # an import of it raises ImportError
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "drift_report" in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names) and "pipeline" not in names


PDF = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj
4 0 obj << /Length 60 >> stream
BT /F1 18 Tf 50 700 Td (Hello \\(you\\)) Tj 0 -20 Td [(wo) -20 (rld)] TJ ET
endstream endobj
5 0 obj << /Type /XObject /Subtype /Image /Width 200 /Height 100 >> endobj
6 0 obj << /Title (A title) /Author (Ann) /CreationDate (D:20240305120000) >> endobj
xref
trailer << /Root 1 0 R /Info 6 0 R >>
%%EOF
"""


def test_pdf(spark, tmp_path):
    from quire.sources import pdf

    (tmp_path / "a.pdf").write_bytes(PDF)
    (tmp_path / "b.pdf").write_bytes(b"junk")
    files = pdf.read(spark, str(tmp_path))
    assert [(r.text, r.x0, r.y0, r.font_size) for r in pdf.read_blocks(files).orderBy("block").collect()] == [("Hello (you)", 50.0, 700.0, 18.0), ("world", 50.0, 680.0, 18.0)]
    assert [(r.width, r.height) for r in pdf.read_images(files).collect()] == [(200, 100)] and pdf.read_images(files, 300).count() == 0
    found = {r.path[-5:]: r for r in pdf.read_metadata(files).collect()}
    assert (found["a.pdf"].title, found["a.pdf"].author, found["a.pdf"].pages) == ("A title", "Ann", 1)
    assert {r.path[-5:]: r.valid for r in pdf.checked(files).collect()} == {"a.pdf": True, "b.pdf": False} and pdf.read_pages(files).count() == 1


def test_sinks(spark, tmp_path):
    from quire.sources import sinks

    articles = spark.createDataFrame([(1, 2, "a & b"), (1, 1, 'say "x", y')], "doc_id long, article_id long, title string")
    sinks.truth_json(articles, f"{tmp_path}/j")
    assert [a.article_id for a in spark.read.json(f"{tmp_path}/j").first().articles] == [1, 2]
    sinks.truth_xml(articles, f"{tmp_path}/x")
    assert {r.title for r in spark.read.format("xml").option("rowTag", "article").load(f"{tmp_path}/x").collect()} == {"a & b", 'say "x", y'}
    sinks.layout_csv(articles, f"{tmp_path}/c")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c").count() == 2
    xml = spark.createDataFrame([(1, '<r b="2" a="1"> <x/> </r>'), (2, "<r"), (3, None)], "id long, xml string")
    out = {r.id: r.xml for r in sinks.formatted(xml, "canonical").collect()}
    assert out == {1: '<r a="1" b="2"> <x></x> </r>', 2: None, 3: None} and sinks.formatted(xml, "compact").first().xml == '<r b="2" a="1"><x /></r>'
    (tmp_path / "config.json").write_text('{"a": {"b": 1, "c": [1, 2]}, "d": "x"}')
    assert {(r.key, r.value) for r in sinks.config(spark, f"{tmp_path}/config.json").collect()} == {("a.b", "1"), ("a.c", "[1, 2]"), ("d", '"x"')}
    pages = spark.createDataFrame([(1, '<doc><page><block _="" id="b1" type="body" bbox="0,0,1,1"><text>two words</text></block></page></doc>')], "doc_id long, xml string")
    assert [(r.token, r.label) for r in sinks.training_examples(pages).collect()] == [("two", "body"), ("words", "body")]


def test_resolution(spark):
    from quire.operators import resolution as Z

    rows = [(1, "i", "c", 0.5, 0.9, 0.6), (1, "j", "c", 0.4, 0.8, 0.7), (2, "k", "d", 0.9, 0.1, 0.1)]
    out = {(r.image_id, r.caption_id, r.strategy) for r in Z.resolve(spark.createDataFrame(rows, "doc_id long, image_id string, caption_id string, confidence double, spatial double, semantic double")).collect()}
    assert out == {("i", "c", "spatial"), ("k", "d", "confidence")}
    groups = Z.conflict_groups(spark.createDataFrame([("i", "c"), ("j", "c"), ("j", "d"), ("k", "e")], "image_id string, caption_id string")).collect()
    assert len({r.conflict for r in groups}) == 2
    arts = spark.createDataFrame([(1, 1, "A", [1, 2]), (1, 2, "a ", [9]), (1, 3, "B", [1, 2]), (1, 4, "C", [5])], "doc_id long, article long, title string, nodes array<int>")
    assert {r.article for r in Z.unique_articles(arts).collect()} == {1, 4}
    boxes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 5.0, 5.0, 15.0, 15.0)], "doc_id long, page int, line_no int, x0 double, y0 double, x1 double, y1 double")
    assert Z.element_overlaps(boxes).count() == 1 and Z.element_overlaps(Z.spread(boxes)).count() == 0
