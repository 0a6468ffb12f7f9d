"""Connected components by alternating large-star and small-star, links and labels in Spark throughout.

Every round is written to the shared folder, so lineage stays short and a lost executor costs one round. The least
neighbour of each vertex comes from map-side partial sums. A vertex with very many links is a hub: fewer than 2 links / HUBS
vertices can be one, so their least neighbours are broadcast and their links are not shuffled by vertex; what is joined
by vertex has at most 2 links / HUBS rows of a vertex, or `HUB`.

Defined results: loops and repeated links change nothing; an empty table of links gives an empty result; vertices must not be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.llm.common import materialize

#: Links from which a vertex can be a hub, and the most hubs.
HUB, HUBS = 1000, 100_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(directed: DataFrame, links: int) -> tuple[DataFrame, DataFrame]:
    """Directed links (u, v) with m, the least v of their u, and (u, m) itself."""
    hub = max(HUB, -(-2 * links // HUBS))
    least = directed.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if links <= hub:
        return directed.join(least.select("u", "m"), "u"), least.select("u", "m")
    least = materialize(least, "least")
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", "m"))  # each has more than 2 links / HUBS of 2 links
    few = directed.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
    return directed.join(hubs, "u").unionByName(few), least.select("u", "m")


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the vertex's smallest neighbour, itself included."""
    joined, _ = _with_least(_both(edges), links)
    return joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, is linked to its smallest neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    joined, least = _with_least(down, links)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for (u, v) links of integer vertices: the smallest vertex that can be reached. Loops are ignored."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = _state(now)
    while state[0]:
        starred = _large_star(now, state[0])
        if state[0] > HUB:  # else the round is small, and one job
            starred = materialize(starred.distinct(), "stars")
        now = materialize(_small_star(starred, state[0]).where("u <> v").distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    # Every vertex now points at its root; roots point nowhere.
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
