"""Connected components of a link table, by alternating large-star and small-star steps.

Each step regroups links around the smallest neighbour, so the number of rounds grows with the logarithm
of a component's diameter, not with its size. A hub's neighbours are never gathered: the smallest neighbour is a
map-side combined minimum, joined back to the links, and a skewed join is split by the planner. Every round is written to the shared folder,
which ends lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.llm import _common as c


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node, linked to the smallest of the node and its neighbours."""
    around = _both_ways(links)
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, linked to the smallest of them. Takes u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component: the smallest node reachable.

    ``links``: long columns u and v, in either order; loops and repeats are allowed, nulls are left out.
    """
    now = c.cut(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        # Stars only, all around their smallest node: no centre is itself linked to a smaller one.
        if state == seen or not now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count():
            many = now.groupBy("u").count().where("count > 1").limit(1).count() if state != seen else 0
            if not many:
                return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                    now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
                )
        seen = state
        now = c.cut(_small_star(_large_star(now)), "stars")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
