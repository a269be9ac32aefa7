"""Connected components of a link table by alternating large-star and small-star steps.

Each step finds the smallest neighbour of every vertex (an aggregation that combines before it
shuffles) and points links at it.  The number of links never grows.  Every step's result is a
written table, so joins read both sides from files and adaptive execution can split the key of a
vertex with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(links: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    near = _both(links) if large else links
    low = scratch.save(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low")
    near = near.where("v > u") if large else near
    joined = near.join(low.hint("merge"), "u")
    if large:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # links run from the larger vertex to the smaller one
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return scratch.save(out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``links(u, v)``: long vertices; rows with a null or u = v are ignored.

    Returns ``(node, root)`` for every vertex with a link; root is the component's smallest vertex.
    """
    now = scratch.save(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        n = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if n == before or n[0] == 0:
            break
        before, k = n, k + 1
        wide = _star(now, scratch, f"{name}-{k}-large", True)
        now = _star(wide, scratch, f"{name}-{k}", False)
        for old in (f"{name}-{k}-large-low", f"{name}-{k}-large", f"{name}-{k}-low", f"{name}-{k - 1}"):
            scratch.drop(old)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return scratch.save(roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), f"{name}-roots")
