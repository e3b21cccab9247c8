"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def _stars(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges (u, v), u > v.  A node's least neighbour is an aggregate with map-side partial results, written before it
    is joined, so that a hub's edges can be split over tasks."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{name}-least")
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = scratch.write(large, f"{name}-large")
    below = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-below")
    small = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = scratch.write(small.unionByName(below.withColumnRenamed("m", "v")).distinct(), f"{name}-small")
    scratch.drop(f"{name}-least", f"{name}-large", f"{name}-below")
    return small


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its least node.

    ``edges`` has two columns of one orderable type; direction, repeats and self-links don't matter, edges with a null
    end are no links.  No edge, hub or component is gathered in one place; each round is written to the shared folder
    and a sum of row hashes tells whether anything has changed.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs, state = scratch.write(pairs, "round-0"), None
    kept = "round-0"
    for k in range(1, max_rounds + 1):
        now = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (now["n"], now["x"]) == state or not now["n"]:
            break
        state = (now["n"], now["x"])
        pairs = _stars(pairs, scratch, f"round-{k}")
        scratch.drop(kept)
        kept = f"round-{k}-small"
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
