"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of ``edges`` (columns a, b: long) with a member of their component.

    Contraction: in each round every node moves to the node of lowest random rank among itself and
    its neighbours, and the edges move along. Ranks are hashes that change with the round, so a
    constant share of the nodes is expected to vanish each time, also on long paths. Both tables
    are written between rounds. Result: node, label; only nodes that have an edge to another node.
    """
    edges = stored(edges.filter("a <> b").select("a", "b").distinct())
    places = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("r"), c.alias("n"))  # noqa: B023, E731
        moves = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min(rank(F.col("b"))), F.first(rank(F.col("a"))))["n"].alias("to")
        )
        moves = stored(moves)
        moved = _moved(_moved(edges, "a", moves), "b", moves)
        edges = stored(
            moved.filter("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        if places is None:
            places = moves.select("node", F.col("to").alias("label"))
        else:
            places = _moved(places, "label", moves)
        places = stored(places)
        turn += 1
    if places is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return places


def _moved(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    step = moves.select(F.col("node").alias("__n"), F.col("to").alias("__t"))
    return (
        rows.join(step, F.col(column) == F.col("__n"), "left")
        .withColumn(column, F.coalesce("__t", column))
        .drop("__n", "__t")
    )
