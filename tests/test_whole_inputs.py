"""Registered queries take all rows of their tables, against brute force."""

from __future__ import annotations

import os
from collections import defaultdict

import duckdb

from quire.plans import records

SF = os.environ.get("QUIRE_TEST_SF", "/root/testdata/sf0.001")


def _greedy(rows: list[tuple]) -> list[tuple]:
    kept: list[tuple] = []
    for x in rows:
        clash = next((y for y in kept if x[1] < y[2] and x[2] > y[1]), None)
        if clash is None:
            kept.append(x)
        elif x[3] > clash[3]:
            kept.remove(clash)
            kept.append(x)
    return kept


def test_spans_of_all_orders(spark):
    lines = duckdb.sql(f"SELECT l_orderkey, l_partkey % 50, l_partkey % 50 + CAST(floor(l_quantity) AS INTEGER), round(1 - l_discount, 2), l_linenumber FROM '{SF}/lineitem.parquet'").fetchall()
    orders = defaultdict(list)
    for x in lines:
        orders[x[0]].append(x)
    expected = sorted(x for rows in orders.values() for x in _greedy(sorted(rows, key=lambda x: (x[1], x[2], x[4]))))
    found = sorted(tuple(r) for r in records.QUERIES["span_dedup"](spark, SF).select("id", "start", "stop", "confidence", "label").collect())
    assert len({x[0] for x in found}) == len(orders)
    assert [x[:3] + x[4:] for x in found] == [x[:3] + x[4:] for x in expected]


def test_extraction_quality_of_all_orders(spark):
    expected = dict(duckdb.sql(f"SELECT l_orderkey % 100, round(avg(round(1 - l_discount, 2)), 6) FROM '{SF}/lineitem.parquet' GROUP BY 1").fetchall())
    found = {r.id: r["mean"] for r in records.QUERIES["extraction_quality"](spark, SF).collect()}
    assert set(found) == set(expected) and all(abs(found[k] - expected[k]) < 2e-6 for k in found)
