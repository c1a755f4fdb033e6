"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm._frames import stored


#: Edges of a node from which it is a hub.
HUB = 1 << 20


def _beside(edges: DataFrame, least: DataFrame, hub: int, total: int) -> DataFrame:
    """``edges`` with ``m`` of their node u; where there can be hubs, their edges stay where they lie and the hubs (at most total / hub) are broadcast."""
    if total < hub:
        return edges.join(least.select("u", "m"), "u")
    least = stored(least, "least")
    hubs = F.broadcast(least.where(F.col("n") >= hub).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") < hub).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", hub: int = HUB) -> DataFrame:
    """``node, root`` for every node that has an edge; ``root`` is the least node id reachable.

    Steps use joins and partial aggregates only, and edges of a node with ``hub`` edges or more are
    joined without a shuffle, so that they are never gathered in one task; rounds grow with the
    logarithm of the largest component.  Self-loops, repeated edges and either direction are allowed;
    an empty input gives an empty result.
    """
    links = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "components")
    seen, total = None, links.count()
    while True:
        # large-star: every neighbour above a node is tied to the least node around it
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _beside(both, least, hub, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "components") if 2 * total >= hub else large
        # small-star: the lower neighbours of a node, and itself, are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _beside(large, least, hub, 2 * total).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        links = stored(small, "components")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen, total = now, now[0]
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
