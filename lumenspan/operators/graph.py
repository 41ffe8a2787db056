"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.sources.shared import written


def _rank(node: Column) -> Column:
    return F.struct(F.xxhash64(node).alias("h"), node.alias("id"))


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every node of the links (a, b); component is its smallest id.

    In every round each node moves to the lowest of itself and its neighbours in a
    random but fixed order, and the links are contracted to the nodes moved to. Stars
    end in two rounds, and long chains at least halve in expectation. All tables stay
    distributed; hot nodes meet only partial minima and joins that Spark can split.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min(_rank(F.col("b"))).alias("near"))
        moves = written(lowest.select(F.col("a").alias("node"), F.least(_rank(F.col("a")), F.col("near"))["id"].alias("to")), "moves")
        if roots is None:
            roots = moves.select(F.col("node").alias("id"), F.col("to").alias("root"))
        else:
            roots = roots.join(moves, roots["root"] == moves["node"], "left").select("id", F.coalesce("to", "root").alias("root"))
        roots = written(roots, "roots")
        ends = edges.join(moves.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(moves.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        edges = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if roots is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    smallest = roots.groupBy("root").agg(F.min("id").alias("component"))
    return roots.join(smallest, "root").select("id", "component")
