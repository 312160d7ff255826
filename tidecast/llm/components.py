"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Alternating large-star and small-star passes (Kiveris et al., 2014): each pass links the
    neighbours of a node to the smallest of them, so paths of any length shrink fast and a hub
    only ever needs a minimum, which is pre-aggregated before the shuffle. Every pass is
    written to the shared folder; the table it replaces is dropped. Nulls and loops are ignored.
    """
    a, b = F.col("a"), F.col("b")
    e = edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    now, seen = scratch.write(e.distinct(), "edges"), None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        to = F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        small = large.join(least, "hi").select(F.explode(to).alias("e")).select("e.*").where("hi != lo").distinct()
        new = scratch.write(small, "star")
        scratch.drop(now)
        now = new
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
