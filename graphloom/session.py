"""The entry point: statements over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .errors import SemanticError
from .graph import Graph
from .plans import ast as A
from .plans.compiler import Rows, has_aggregate, returns
from .plans.parser import UPDATES, parse


class GraphSession:
    """Holds the current snapshot of a graph, its schema, and results kept by procedures.

    ``cypher`` returns a lazy DataFrame for reads.  Updates are carried out at once, in the
    order of their clauses, and replace the snapshot when the statement has succeeded.
    """

    def __init__(self, spark: SparkSession, graph: Graph | None = None, expand_truncation: tuple[int, str] | None = None):
        """``expand_truncation`` ``(k, property)`` follows at most ``k`` relationships from each node of a
        variable-length walk, those of largest property first."""
        from .catalog import Catalog

        self.spark = spark
        self.expand_truncation = expand_truncation
        self.graph = graph or Graph(spark)
        self.catalog = Catalog()
        self.results: dict[str, DataFrame] = {}
        #: Ranges of numbers of the changes that the graph holds, ascending (see ``streaming.changes``).
        self.applied: list[tuple[int, int]] = []
        self.projections: dict[str, tuple[DataFrame, DataFrame]] = {}

    def cypher(self, text: str, **params) -> DataFrame:
        tree = parse(text)
        if not isinstance(tree, A.Query):
            return self.catalog.run(self, tree)
        rows = Rows(self.graph.copy(), params)
        rows.session = self
        updates = any(isinstance(n, UPDATES) for n in tree.walk())
        if len(tree.arms) == 1:
            rows.reach = _asks_reach(tree.arms[0])
        out = rows.run(tree)
        last = tree.arms[0][-1]
        calls = isinstance(last, A.CallProcedure)
        if isinstance(last, A.Projection) or calls or (isinstance(last, A.CallQuery) and (returns(last.query) or not updates)):
            result = out.result()
        elif updates:
            result = self.spark.createDataFrame([], "nothing string").drop("nothing")
        else:
            raise SemanticError("a query must return something")
        if updates:
            from .storage import staged

            self.catalog.check(rows.graph)
            if result.columns:
                result = staged(result, "result")
            self.graph = rows.graph
        return result


def _asks_reach(clauses: tuple) -> bool:
    """Whether the query only asks which nodes a variable-length hop can reach, not by which walks."""
    if len(clauses) != 2 or not isinstance(clauses[0], A.Match) or not isinstance(clauses[1], A.Projection):
        return False
    match, out = clauses
    if match.optional or len(match.paths) != 1 or match.paths[0].var or len(match.paths[0].elements) != 3:
        return False
    if match.paths[0].elements[1].var:
        return False
    if out.distinct and not any(has_aggregate(i.expr) for i in out.items):
        return True
    calls = [n for i in out.items for n in i.expr.walk() if isinstance(n, A.Call) and has_aggregate(n)]
    return bool(calls) and all(c.distinct or c.name in ("min", "max") for c in calls)
