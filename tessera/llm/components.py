"""Connected components of a graph held as a table of edges, by alternating large-star and small-star steps.

Each step is one partial aggregate and one join on the node.  A node with very many
neighbours is a partial minimum in the aggregate.  In the large star it is also a skewed
side of the join: the minima are a table of their own there, so that both sides of the
join are plain shuffles, which adaptive execution can split.  In the small star a node
joins only the different minima of its neighbours.  The number of rounds grows with the logarithm of the
longest chain.  Every round is written to the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Edges in a file of a round: a small graph's rounds are a task each, a large one's as many as there are files.
ROWS_A_FILE = 200_000


def large_star(both: DataFrame, first: DataFrame) -> DataFrame:
    """Of edges in both directions: each greater neighbour of u to first's m of u."""
    return both.where("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes that have an edge. Values must be ordered, not null."""
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = scratch.keep(now, "edges")
    n = now.count()
    for _ in range(most_rounds):
        if not n:
            break
        # large star: each greater neighbour of u to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        files = -(-n // ROWS_A_FILE)
        first = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(files), "least")
        large = large_star(both, first).distinct()
        # small star: u and each lesser neighbour of u to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.keep(small.coalesce(files), "edges")  # a round gives no more edges than it had
        m = after.count()
        same = n == m and now.exceptAll(after).isEmpty()
        scratch.forget(now)
        scratch.forget(first)
        now, n = after, m
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    scratch.tidy(spark)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
