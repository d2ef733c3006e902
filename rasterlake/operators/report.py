"""Per-file reports and batch totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E


def report(original: Column, new: Column, technique: Column, label: Column, notes: Column | None = None, hit: Column | None = None, ssim: Column | None = None) -> Column:
    nothing = F.array().cast("array<struct<label:string,value:string>>")
    return F.struct(
        original.alias("original_bytes"),
        new.alias("new_bytes"),
        E.reduction_pct(original, new).alias("reduction_pct"),
        technique.alias("technique"),
        label.alias("format_label"),
        (nothing if notes is None else F.coalesce(notes, nothing)).alias("notes"),
        (F.lit(None).cast("boolean") if hit is None else hit).alias("hit_target"),
        (F.lit(None).cast("double") if ssim is None else ssim).alias("ssim"),
    )


def first_seen(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Per group the distinct values in order of their first appearance."""
    first = rows.groupBy(*by, value).agg(F.min(order).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v"))))
    return first.groupBy(*by).agg(F.transform(listed, lambda s: s["v"]).alias("values"))


def batch_totals(rows: DataFrame, by: list[str], original: str, new: str, technique: str | None = None, order: str | None = None) -> DataFrame:
    """Counts, sums, saved bytes (never negative), percent of the sums, best percent of a file, and techniques in
    order of first use."""
    pct = E.reduction_pct(F.col(original), F.col(new))
    made = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("file_count"), F.sum(original).alias("original_bytes"), F.sum(new).alias("new_bytes"), F.greatest(F.max(pct), F.lit(0.0)).alias("best_reduction_pct"))
    saved = F.col("original_bytes") - F.col("new_bytes")
    made = made.withColumn("saved_bytes", F.greatest(saved, F.lit(0).cast(rows.schema[original].dataType)))
    made = made.withColumn("reduction_pct", E.reduction_pct(F.col("original_bytes"), F.col("new_bytes")))
    if technique:
        made = made.join(first_seen(rows, by, technique, order).withColumnRenamed("values", "techniques"), by)
    return made
