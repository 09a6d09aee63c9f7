"""Connected components over an edge table, by alternating large and small stars.

Each round is two joins on node ids (Kiveris et al., Connected Components in MapReduce and
Beyond); the edges of a round are a table in the shared folder. Neighbour lists are never
gathered: only minima per node are, which combine before the shuffle, and the join of a
hub with its neighbours is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    # As a table of its own: both sides of the join are then plain shuffles, of which a hub's can be split.
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")), "least-neighbours")
    return both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
    moved = down.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionAll(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()


def roots(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of the component of every node that has an edge and isn't that node itself.

    edges: columns a and b of one ordered type. No edges give no rows.
    """
    edges = written(edges.where("a <> b").select("a", "b"), "edges")
    before = None
    for _ in range(most_rounds):
        edges = written(_small_star(_large_star(edges)), "stars")
        # The same edges as before, by number and by two sums over their hashes.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError("components did not settle")
