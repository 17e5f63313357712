"""Connected components by repeated contraction of a graph with random node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from munjang.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for the nodes of ``edges`` (a, b): equal roots within a component.

    Each round every node joins its smallest neighbour, and the edges between
    the merged nodes go on. Ids are hashes, so a round leaves a constant share
    of the nodes on average, whatever the shape of the graph. Each round is
    written to the shared folder.
    """
    edges = edges.where("a <> b").distinct()
    left = shared.save(edges, "edges")
    nodes = None
    while not left.isEmpty():
        both = left.unionByName(left.selectExpr("b AS a", "a AS b"))
        step = shared.save(both.groupBy("a").agg(F.min("b").alias("b")).selectExpr("a AS id", "least(a, b) AS root"), "steps")
        # A chain of joins is followed one link further; the rest is for later rounds.
        to = step.selectExpr("id AS root", "root AS further")
        step = shared.save(step.join(to, "root", "left").selectExpr("id", "coalesce(further, root) AS root"), "steps")
        a, b = step.selectExpr("id AS a", "root AS ra"), step.selectExpr("id AS b", "root AS rb")
        left = shared.save(left.join(a, "a").join(b, "b").selectExpr("ra AS a", "rb AS b").where("a <> b").distinct(), "edges")
        nodes = step if nodes is None else shared.save(nodes.join(step.selectExpr("id AS root", "root AS next"), "root", "left").selectExpr("id", "coalesce(next, root) AS root"), "roots")
    return nodes if nodes is not None else left.selectExpr("a AS id", "b AS root")
