"""Connected components of an edge table, by alternating stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rounds halve path lengths, so any graph that fits into storage needs far fewer; more raise an error.
MAX_ROUNDS = 200


def _stars(both: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours are tied to the least node among them and itself. The minimum is pre-aggregated
    and joined back, so that a node of very many neighbours is in no single task. Ties go from the larger node to the
    smaller one; those of large stars may repeat, but are no more than the edges."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
    tied = both.join(least, F.col("u") == F.col("k"))
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    made = tied.select("v", "m").unionByName(least.select(F.col("k").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return made.where("u <> v").distinct()


def _at_rest(edges: DataFrame) -> bool:
    """Whether every node is tied to one smaller node at most, and none that others are tied to is tied itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("root")).unionByName(edges.select("v", F.lit(0), F.lit(1)).toDF("node", "tied", "root"))
    ends = ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("root").alias("root"))
    return ends.agg(F.count_if(F.col("tied") + F.col("root") > 1)).first()[0] == 0


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component): the least node that each node of `edges` (a, b) reaches. Edges that are stars already, each
    around its least node, cost no round."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = scratch.put(now, f"{name}-0")
    for k in range(1, MAX_ROUNDS):
        if _at_rest(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = scratch.put(_stars(_stars(both, large=True), large=False), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    else:
        raise RuntimeError("components did not come to rest")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
