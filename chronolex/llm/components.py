"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import released, stored

MAX_ROUNDS = 200


def compressed(edges: DataFrame) -> DataFrame:
    """(a, b) with the components of edges, but fewer rows: a node keeps one edge, to its least neighbour, and ties its
    other smaller neighbours to that one; those ties repeat from node to node and are kept once.

    A node's edges to smaller ones meet in a task, so they must be few, as a document's signatures are.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rows = edges.select("a", "b", F.min("a").over(Window.partitionBy("b")).alias("m"))
    return rows.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of longs -> (node, component), the least node that edges reach; nodes without an edge are not in it.

    Each round moves every node to the one of it and its neighbours that comes first in an order by hash, another one
    each round, and keeps the edges between the nodes that are left, so the graph shrinks by a share a round whatever
    its shape: a star, however large, is gone after two.  Then the moves are followed back.  Minima are taken before the
    shuffle, so a node with many edges sends one row per task; every table is written to the shared folder, so that a
    lost executor costs one round.
    """
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    moves: list[DataFrame] = []
    for round_ in range(MAX_ROUNDS):
        both = left.select("a", "b").union(left.select("b", "a")).toDF("a", "b")
        place = lambda c, k=round_: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("x"))
        to = both.groupBy("a").agg(F.min(place("b")).alias("m")).select("a", F.least(place("a"), F.col("m")).getField("x").alias("to"))
        moves.append(stored(to, "moves"))
        ends = [moves[-1].select(F.col("a").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        pairs = left.join(ends[0], "a").join(ends[1], "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        nexts = stored(pairs.where("a <> b").distinct(), "edges")
        released(left)
        left = nexts
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
    found = moves.pop().select(F.col("a").alias("node"), F.col("to").alias("root"))
    while moves:
        last = moves.pop()
        up = found.select(F.col("node").alias("to"), "root")
        found = stored(last.join(up, "to", "left").select(F.col("a").alias("node"), F.coalesce("root", "to").alias("root")), "roots")
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return stored(found.join(least, "root").select("node", "component"), "components")
