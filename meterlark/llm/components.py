"""Connected components of a table of links, by rounds of joins until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.llm._shared import scratch, settled


def _least(pairs: DataFrame) -> DataFrame:
    """The least neighbour of each node, as a table of its own, so that the join after it can split a hot node."""
    return settled(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node, root being the least node reachable.

    Each round ties larger neighbours to a node's least neighbour and smaller ones to each other; the number
    of rounds grows with the logarithm of the nodes.  The driver sees a count and a checksum per round.
    Links with a null end and loops are ignored; repeated links count once; no links give no rows.
    """
    edges = settled(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"u != v and {a} is not null and {b} is not null").distinct(), "links")
    mark = None
    while True:
        sign = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == mark or not sign[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        mark = sign
        with scratch(links.sparkSession):
            both = edges.union(edges.select("v", "u"))
            least = _least(both).select("u", F.least("u", "m").alias("m"))
            large = settled(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
            least = _least(large)
            tied = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = settled(tied.union(least.select("u", F.col("m").alias("v"))).distinct(), "small", keep=True)
