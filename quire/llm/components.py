"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored


def components(links: DataFrame) -> DataFrame:
    """(v, root) for each end of the links (a, b); ``root`` is the least end reachable.

    Each round maps every vertex to its least neighbour and contracts the links accordingly.  Ends
    here are hashes, in no order along a path, so a constant share of vertices goes each round; a path whose
    ids ascend from end to end would lose one vertex a round.  All rounds are joins on vertex ids; the mapping so far is
    written out, so lineage stays short.
    """
    links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "least")
        steps.append(least)
        to_a, to_b = least.select("a", F.col("to").alias("ra")), least.select(F.col("a").alias("b"), F.col("to").alias("rb"))
        moved = links.join(to_a.hint("shuffle_merge"), "a").join(to_b.hint("shuffle_merge"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        links = stored(moved.filter("a <> b").distinct(), "links")
    if not steps:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = steps[0].select(F.col("a").alias("v"), F.col("to").alias("root"))
    for step in steps[1:]:
        step = step.select(F.col("a").alias("root"), "to").hint("shuffle_merge")
        roots = roots.join(step, "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    return stored(roots, "roots")
