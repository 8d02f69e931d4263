"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import joined_evenly, stored


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b (long). One row per linked id: id, component (the smallest id reachable).

    Each step joins edges with a minimum per node, so no node's neighbours meet in memory, and nodes of very many edges are no one task's load; each
    round is stored in the shared folder. The rounds grow with the logarithm of a component's size, and end when the edges no longer change.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
        large = joined_evenly(both, least, ["u"], "n", 2 * seen["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        down = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "down")
        small = joined_evenly(large, down, ["u"], "n", seen["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
