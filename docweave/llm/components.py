"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of these; edges hold ``u > v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(scratch: Scratch, edges: DataFrame, name: str = "star") -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is its least node.

    Each round costs two shuffled joins on the node. A node with very many
    neighbours only occurs as a join key, which adaptive execution splits.
    The driver sees two sums a round, never links. Rounds end when neither
    step changes the links.
    """
    clean = edges.where("u is not null and v is not null and u <> v")
    clean = clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen, step = scratch.save(clean, f"{name}0"), None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen, step = state, step + 1
        now = scratch.save(_small_star(_large_star(now)), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
