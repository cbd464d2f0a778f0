"""Connected components of links between 64-bit nodes, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import checkpointed


def component_of(links: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in ``links`` (a, b); one root for each component.

    In every round each node moves to the neighbour, or itself, that comes first in an order
    drawn anew by hashing, and links between the same two nodes fall together; the number of
    nodes with links falls by a constant share whatever the shape. Sums and joins only: no
    task holds the neighbours of a node. Rounds are checkpointed to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    links = checkpointed(links.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    roots = links.select(a.alias("node")).union(links.select(b.alias("node"))).distinct()
    roots = checkpointed(roots.withColumn("root", F.col("node")))
    turn = 0
    while not links.isEmpty():
        turn += 1
        ways = links.union(links.select("b", "a"))
        ordered = [F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n")) for c in ("a", "b")]
        moves = ways.groupBy("a").agg(F.min(ordered[1]).alias("first"), F.min(ordered[0]).alias("own"))
        moves = moves.select(a.alias("old"), F.least("first", "own")["n"].alias("new"))
        moves = checkpointed(moves)
        roots = roots.join(moves, F.col("root") == F.col("old"), "left")
        roots = checkpointed(roots.select("node", F.coalesce("new", "root").alias("root")))
        one = links.join(moves, a == F.col("old")).select(F.col("new").alias("a"), "b")
        two = one.join(moves, b == F.col("old")).select("a", F.col("new").alias("b"))
        ends = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
        links = checkpointed(two.where(a != b).select(*ends).distinct())
    return roots
