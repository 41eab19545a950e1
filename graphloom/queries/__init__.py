"""Registered queries over the star-schema graph, with their SQL.

``TEXTS`` maps a name to ``(statement, parameters, SQL or None)``; ``CALLS`` holds queries that
take more than one statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import GraphSession
from ..sources.tables import graph_of, node_id
from .special import CALLS, CALLS_SQL
from .texts import TEXTS

FLAGSHIP = "segment_totals"


def _make(text: str, params: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return GraphSession(spark, graph_of(spark, sf_dir)).cypher(text, **params)

    return run


QUERIES = {name: _make(text, params) for name, (text, params, _) in TEXTS.items()} | CALLS
ORACLE_SQL = {name: sql for name, (_, _, sql) in TEXTS.items() if sql} | CALLS_SQL

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "node_id"]
