"""Exact dedup with reference rewriting, anti joins, and winners per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(items: DataFrame, id_col: str, payload: str) -> DataFrame:
    """(id, canonical): the least id with an equal payload. Equal payloads meet by length and SHA-256; the
    minimum is pre-aggregated, so a payload that very many rows hold is in no single task."""
    key = [F.length(payload).alias("k_len"), F.sha2(F.col(payload).cast("binary"), 256).alias("k_sha")]
    named = items.select(F.col(id_col), *key)
    least = named.groupBy("k_len", "k_sha").agg(F.min(id_col).alias("canonical"))
    return named.join(least, ["k_len", "k_sha"]).select(id_col, "canonical")


def dedup_savings(items: DataFrame, id_col: str, payload: str, batch: str) -> DataFrame:
    """Per batch: bytes before and after keeping one of each payload, and how many were merged."""
    size = F.octet_length(payload).cast("long")
    named = items.select(F.col(id_col).alias("i"), F.col(batch).alias("b"), size.alias("n"), F.length(payload).alias("k"), F.sha2(F.col(payload).cast("binary"), 256).alias("s"))
    kept = named.groupBy("k", "s").agg(F.min(F.struct("i", "b", "n")).alias("one")).select("one.b", F.col("one.n").alias("kept"))
    # one aggregation over both sides: what is there counts as before, what is kept as after
    rows = named.select("b", "n", F.lit(0).cast("long").alias("kept"), F.lit(1).alias("all"), F.lit(0).alias("some"))
    rows = rows.unionByName(kept.select("b", F.lit(0).cast("long").alias("n"), "kept", F.lit(0).alias("all"), F.lit(1).alias("some")))
    return rows.groupBy(F.col("b").alias(batch)).agg(F.sum("n").alias("original_bytes"), F.sum("kept").alias("new_bytes"), (F.sum("all") - F.sum("some")).alias("merged"))


def remap(edges: DataFrame, target: str, table: DataFrame, id_col: str) -> DataFrame:
    """Edges with their target replaced once by its canonical id; unknown targets stay."""
    pairs = table.select(F.col(id_col).alias("was"), F.col("canonical").alias("now"))
    return edges.join(pairs, F.col(target) == F.col("was"), "left").withColumn(target, F.coalesce("now", target)).drop("was", "now")


def unreferenced(items: DataFrame, refs: DataFrame, on) -> DataFrame:
    return items.join(refs, on, "left_anti")


def winners(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key; the order must leave no tie."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place_", place).where("place_ = 1").drop("place_")


def moved(position, start: int, end: int):
    """The place of each element after the one at `start` was moved to `end`."""
    if start <= end:
        shifted = F.when((position > start) & (position <= end), position - 1)
    else:
        shifted = F.when((position >= end) & (position < start), position + 1)
    return F.when(position == start, F.lit(end)).otherwise(F.coalesce(shifted, position))


def first_rows(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key by `order`: what is met first counts, as of an image that several pages decode."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("first")).select(*keys, *(F.col(f"first.{c}").alias(c) for c in rest))
