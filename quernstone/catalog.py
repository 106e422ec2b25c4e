"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.operators import alignment, coverage, embedding, governance, graph, lifecycle, ontology, registry, relational, releases, similarity, spans, stages, tables, triple_query
from quernstone.plans import assessment, expressions, extraction, grids, relations, rule_queries, shared_line, text_queries
from quernstone.sources import reflection, scans, turtle
from quernstone.streaming import changes, recompute

FLAGSHIP = "assessment"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (assessment, coverage, governance, ontology, registry, extraction, relations, grids, expressions, rule_queries, shared_line, relational, releases, graph, triple_query, spans, text_queries, similarity, alignment, embedding, stages, lifecycle, changes, recompute, scans, turtle, reflection, tables):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
