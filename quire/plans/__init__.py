"""Registered queries: each module has QUERIES and the ORACLE_SQL of those that SQL can express."""

from quire.plans import evaluation, documents, records, reports, coverage

MODULES = [evaluation, documents, records, reports, coverage]
