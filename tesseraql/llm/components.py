"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two shuffles over at most twice the edges; no adjacency list is ever collected, and
the edges are kept in the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stored


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """pairs (a, b): neighbours b of a.  Links neighbours to the least of a and its neighbours."""
    # a table of its own, so that the join deals both sides anew and Spark can split a node with very many neighbours
    least = stored(pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "components-least")
    linked = pairs.join(least, "a")
    out = linked.where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m"))).select(F.col("b").alias("x"), F.col("m").alias("y"))
    if small:
        out = linked.where(F.col("b") != F.col("m")).select(F.col("b").alias("x"), F.col("m").alias("y"))
        out = out.union(least.where("a <> m").select(F.col("a").alias("x"), F.col("m").alias("y")))
    out = stored(out.distinct(), "components-edges")
    drop(least)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node it can reach.

    Repeated edges, loops and either direction are allowed; no edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "components-edges")
    state = None
    for _ in range(rounds):
        both = now.select(F.col("x").alias("a"), F.col("y").alias("b")).union(now.select(F.col("y").alias("a"), F.col("x").alias("b")))
        large = _star(both, small=False)
        drop(now)
        now = _star(large.select(F.col("x").alias("a"), F.col("y").alias("b")), small=True)
        drop(large)
        sums = now.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(x, y) as decimal(38,0))"))).first()
        if tuple(sums) == state:
            break
        state = tuple(sums)
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    roots = now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
    return now.select(F.col("x").alias("node"), F.col("y").alias("root")).union(roots)
