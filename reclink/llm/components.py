"""Connected components of a graph too large for one machine: alternating large-star and small-star steps.

Each round is two equi-joins with aggregated minima; edges shrink towards stars whose centre is the smallest id.  A node with
more than ``HUB`` neighbours would send them all to one task of such a join; these few nodes (at most the edges' number over
``HUB``) are joined by broadcast instead, if they are no more than ``MOST_HUBS``, and their edges stay where they are.  Rounds
are written to the shared folder, so that a lost executor costs one round at most.  Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.session import dropped, written

HUB, MOST_HUBS = 1_000, 500_000


def _with_least(pairs: DataFrame, both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (u, v) with m, the smallest of u's partners in ``both`` and u; and the table of (u, m, n) behind it."""
    low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    hubs = low.where(F.col("n") > HUB)
    if not 0 < hubs.count() <= MOST_HUBS:
        return pairs.join(low, "u"), low
    few = F.broadcast(hubs.select("u", "m", "n"))
    return pairs.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(low, "u").unionByName(pairs.join(few, "u")), low


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link the larger neighbours of each node to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, low = _with_least(both.where("v > u"), both)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link the smaller neighbours of each node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined, low = _with_least(down, down)
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), low


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: bigint); component is the smallest node that is reachable."""
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        large, low = _large_star(now)
        middle = written(large, "edges")
        dropped(now.sparkSession, now, low)
        small, low = _small_star(middle)
        now = written(small, "edges")
        dropped(now.sparkSession, middle, low)
        # stars: no centre is itself a leaf, and no leaf has two centres; then a further round changes nothing
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("bigint")).alias("h"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("x")).first()
        if mark == seen:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
