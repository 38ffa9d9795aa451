"""Connected components of an undirected graph, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b) to ``(id, label)``: label is the smallest id that id reaches.

    Alternates large-star and small-star steps (each a minimum by node, which
    combines before its shuffle, and an equi join that adaptive execution can
    split when a node is hot) until the edges are a star around each smallest
    id. Self loops and rows with a null end are ignored; nodes without an edge
    are not listed. The rounds grow with the logarithm of the node count.
    """
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    )
