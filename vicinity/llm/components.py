"""Connected components of a link table, as DataFrame joins and aggregates only.

Large-star / small-star (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Nothing is
gathered on the driver but two numbers a round; each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every neighbour above a node to the smallest node in its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join deals out both sides itself and can split the links of a hub
    low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them. Edges run from u down to v."""
    low = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """The star forest of the components of ``links`` (columns u, v; long).

    Returns (u, root): a row for each node that is not the smallest of its component. A link from a node to
    itself, or one with a null, joins nothing. No row is returned for an empty table.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "links")
    mark = _settled(edges)
    while mark[0]:
        step = written(_large_star(edges).where("u > v").distinct(), "links")
        nxt = written(_small_star(step).where("u > v").distinct(), "links")
        drop_written(edges)
        drop_written(step)
        edges, before = nxt, mark
        mark = _settled(edges)
        if mark == before:
            break
    return edges.select("u", F.col("v").alias("root"))
