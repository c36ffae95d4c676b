"""Connected components of a graph given by its links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallydesk.llm.common import staged


def _with_least(links: DataFrame, both_ways: bool) -> DataFrame:
    """(u, v, m): each link of u with the least of u and its neighbours."""
    if both_ways:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # One row per node: a sum made on the map side, joined back, so that a hub is split like any hot key.
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return around.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    near = _with_least(links, both_ways=True)
    return near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    near = _with_least(links, both_ways=False)
    # Either end of a link goes to the least; both in one pass, so that the plan holds the joins once.
    ends = F.array(*[F.struct(F.col(end).alias("u"), F.col("m").alias("v")) for end in ("v", "u")])
    return near.select(F.explode(ends).alias("end")).select("end.u", "end.v")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link in (u, v); a component is its least node.

    Links come in any order and may repeat. Nulls and links of a node with itself are left out.
    Both steps of every round are written to the shared folder.
    """
    current, before = links.filter("u <> v").select("u", "v"), None
    while before is None or before[0]:
        # Each star by itself: the second reads the first three times, and the driver holds the plan.
        large = staged(_large_star(current), "stars")
        current = staged(_small_star(large).filter("u <> v").distinct(), "links")
        after = _state(current)
        if after == before:
            break
        before = after
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def with_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """What ``components`` gives for the links that ``found`` comes from and these too."""
    return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))
