"""Connected components of an edge list by alternating large-star and small-star steps, each step written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, stage_table


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Staged (node, root) for every node of an edge list of longs that is not its component's smallest.

    Hot nodes are safe: minima are pre-aggregated, and the joins back on a node are ones that adaptive execution splits.
    Self-loops and repeated edges are harmless; an edge with a null end is ignored; no edges give no rows.
    """
    e = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = stage_table(e, "edges")
    seen = _state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage_table(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = stage_table(small, "small-star")
        drop_table(large)
        drop_table(e)
        e, before, seen = small, seen, _state(small)
        if seen == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
