"""Entities of the engine derived from the driver's tables by plain arithmetic, and the same rules as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT = 600.0, 800.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, metric, brand, ts, accuracy: one evaluation per event."""
    accuracy = 1 - F.least(F.col("value"), F.lit(500.0)) / 500
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("metric"), (F.col("user_id") % 4).cast("int").alias("brand"), "ts", accuracy.alias("accuracy"))


def article_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, article_id, the four field accuracies and ts: one evaluation per order line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("article_id"),
        (1 - 4 * F.col("l_discount")).alias("title"),
        (1 - 4 * F.col("l_tax")).alias("body"),
        (F.col("l_quantity") / 50).alias("contributors"),
        F.when(F.col("l_returnflag") != "R", 1.0).otherwise(0.0).alias("media"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_suppkey") % 4).cast("int").alias("brand"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, brand, status, priority, created_at, scheduled_at: one job per order."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        (F.col("o_custkey") % 4).cast("int").alias("brand"),
        status.alias("status"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.col("o_orderdate").alias("created_at"),
        F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 5 AS INT))").alias("scheduled_at"),
        F.col("o_totalprice").alias("size"),
    )


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("default_value"))


def parameter_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("patch"), F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_linestatus") == "F", "active").otherwise("draft").alias("status"), F.col("l_shipdate").alias("created_at"),
    )


def parameter_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("patch"), (F.col("l_suppkey") % 4).cast("int").alias("brand"),
        F.col("l_quantity").alias("priority"), F.col("l_discount").alias("value"), F.col("l_shipdate").alias("valid_from"), F.expr("l_shipdate + INTERVAL 30 DAY").alias("valid_until"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, page, box, font_size, is_bold, n_words, text: the lines of documents on a grid of three columns."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    n = F.col("line_no")
    slot = n % 12
    lines = lines.withColumns({
        "page": F.floor(n / 12).cast("int"),
        "x0": (50 + 180 * (slot % 3)).cast("double"),
        "y0": (20 + 170 * F.floor(slot / 3) + (n * 7) % 11).cast("double"),
        "font_size": (8 + (n * 5) % 13).cast("double"),
        "is_bold": n % 4 == 0,
    })
    lines = lines.withColumns({"x1": F.col("x0") + 150 - (n * 13) % 40, "y1": F.col("y0") + 30 + F.octet_length("text") % 60})
    return lines.withColumn("n_words", F.size(F.filter(F.split("text", " "), lambda w: w != "")))


def images(blocks_: DataFrame) -> DataFrame:
    """image_id, doc_id, page and box: one image below every fifth block."""
    return blocks_.filter("line_no % 5 = 0").select(
        F.concat_ws("_", F.lit("img"), "doc_id", "line_no").alias("image_id"), "doc_id", "page",
        (F.col("x0") + 20).alias("x0"), (F.col("y1") + 10).alias("y0"), (F.col("x0") + 100).alias("x1"), (F.col("y1") + 90).alias("y1"),
    )


#: The same rules as common table expressions of the oracle.
SQL = {
    "document_evaluations": "document_evaluations AS (SELECT event_id, event_type AS metric, CAST(user_id % 4 AS INTEGER) AS brand, ts, 1 - least(value, 500.0::DOUBLE) / 500 AS accuracy FROM events)",
    "article_evaluations": "article_evaluations AS (SELECT l_orderkey AS doc_id, l_linenumber AS article_id, 1 - 4 * l_discount AS title, 1 - 4 * l_tax AS body, l_quantity / 50 AS contributors, CASE WHEN l_returnflag <> 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS media, l_shipdate AS ts, CAST(l_suppkey % 4 AS INTEGER) AS brand FROM lineitem)",
    "jobs": "jobs AS (SELECT o_orderkey AS job_id, CAST(o_custkey % 4 AS INTEGER) AS brand, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, CAST(6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS priority, o_orderdate AS created_at, o_orderdate + CAST(o_orderkey % 5 AS INTEGER) * INTERVAL 1 DAY AS scheduled_at, o_totalprice AS size FROM orders)",
    "parameters": "parameters AS (SELECT p_partkey AS key, p_brand AS category, p_retailprice AS default_value FROM part)",
    "parameter_versions": "parameter_versions AS (SELECT l_partkey AS key, l_orderkey AS run, l_linenumber AS patch, l_extendedprice AS value, CASE l_linestatus WHEN 'F' THEN 'active' ELSE 'draft' END AS status, l_shipdate AS created_at FROM lineitem)",
    "parameter_overrides": "parameter_overrides AS (SELECT l_partkey AS key, l_orderkey AS run, l_linenumber AS patch, CAST(l_suppkey % 4 AS INTEGER) AS brand, l_quantity AS priority, l_discount AS value, l_shipdate AS valid_from, l_shipdate + INTERVAL 30 DAY AS valid_until FROM lineitem WHERE l_returnflag = 'R')",
    "blocks": (
        "raw_lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), "
        "lines AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, parts[CAST(i AS INTEGER) + 1] AS text FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS i FROM raw_lines)), "
        "placed AS (SELECT *, CAST(line_no // 12 AS INTEGER) AS page, CAST(50 + 180 * ((line_no % 12) % 3) AS DOUBLE) AS x0, CAST(20 + 170 * ((line_no % 12) // 3) + (line_no * 7) % 11 AS DOUBLE) AS y0, CAST(8 + (line_no * 5) % 13 AS DOUBLE) AS font_size, line_no % 4 = 0 AS is_bold FROM lines), "
        "blocks AS (SELECT *, x0 + 150 - (line_no * 13) % 40 AS x1, y0 + 30 + strlen(text) % 60 AS y1, CAST(len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS INTEGER) AS n_words FROM placed)"
    ),
    "images": "images AS (SELECT concat_ws('_', 'img', doc_id, line_no) AS image_id, doc_id, page, x0 + 20 AS x0, y1 + 10 AS y0, x0 + 100 AS x1, y1 + 90 AS y1 FROM blocks WHERE line_no % 5 = 0)",
}


def with_(names: str, body: str) -> str:
    """An oracle statement over the named entities."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + " " + body
