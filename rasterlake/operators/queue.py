"""The batch queue as a table: files are added, taken out, changed and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without(queue: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return queue.join(gone.select(key), key, "left_anti")


def patched(queue: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Columns of `patch` replace those of the queue where they aren't null; keys that aren't queued are ignored."""
    fresh = [c for c in patch.columns if c != key]
    named = patch.select(key, *(F.col(c).alias(f"{c}_new") for c in fresh))
    joined = queue.join(named, key, "left")
    return joined.select(*(F.coalesce(f"{c}_new", c).alias(c) if c in fresh else c for c in queue.columns))


def appended(queue: DataFrame, more: DataFrame) -> DataFrame:
    return queue.unionByName(more.select(*queue.columns))


def counts(queue: DataFrame, by: list[str], **flags: Column) -> DataFrame:
    return queue.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(flag).alias(name) for name, flag in flags.items()))
