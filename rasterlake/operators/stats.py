"""Histograms, thresholds and content classes from pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as E
from .stored import stored


def pixels(tiles: DataFrame, id_col: str, values: str, *carry: str) -> DataFrame:
    """One row per component: id, p (from 0), g (gray 0..255)."""
    return tiles.select(id_col, *carry, F.posexplode(values).alias("p", "v")).select(id_col, *carry, "p", E.gray_of_unit(F.col("v")).alias("g"))


def tone_histogram(px: DataFrame, by: str, luma: Column) -> DataFrame:
    return px.groupBy(by, F.floor(luma).cast("int").alias("t")).agg(F.count(F.lit(1)).alias("n"))


def otsu(histogram: DataFrame, by: str) -> DataFrame:
    """Threshold of largest between-class variance, earliest of equals; 0 for one tone. At most 256 rows a group."""
    along = Window.partitionBy(by).orderBy("t")
    h = histogram.withColumns({"w": F.sum("n").over(along), "s": F.sum(F.col("t") * F.col("n")).over(along)})
    h = h.withColumns({"all_n": F.sum("n").over(Window.partitionBy(by)), "all_s": F.sum(F.col("t") * F.col("n")).over(Window.partitionBy(by))})
    front = F.col("all_n") - F.col("w")
    gap = F.col("s") / F.col("w") - (F.col("all_s") - F.col("s")) / F.when(front > 0, front)
    h = h.withColumn("var", F.when(front > 0, (F.col("w") * front).cast("double") * (gap * gap)))
    best = F.max_by(F.col("t"), F.when(F.col("var").isNotNull(), F.struct(F.col("var"), (-F.col("t")).alias("first"))))
    return h.groupBy(by).agg(F.coalesce(best, F.lit(0)).alias("threshold"))


def content_class(px: DataFrame, by: str, order: list[str], stride: Column | None = None) -> DataFrame:
    """Distinct colours (capped), flatness, extreme ratio and class of each image. Each sampled pixel is compared
    with the one sampled before it, across row ends; `stride` keeps every so-manieth pixel."""
    if stride is not None:
        px = px.where(F.col("p") % stride == 0)
    tone = E.luma(F.col("g"), F.col("g"), F.col("g"))
    same = F.coalesce((F.lag("g").over(Window.partitionBy(by).orderBy(*order)) == F.col("g")).cast("int"), F.lit(0))
    extreme = ((tone <= K.NEAR_BLACK) | (tone >= K.NEAR_WHITE)).cast("int")
    seen = px.select(by, "g", same.alias("same"), extreme.alias("extreme"))
    made = seen.groupBy(by).agg(F.least(F.count_distinct("g"), F.lit(K.UNIQUE_CAP)).alias("unique_colors"), (F.sum("same") / F.count(F.lit(1))).alias("flatness"), (F.sum("extreme") / F.count(F.lit(1))).alias("extreme_ratio"))
    return made.withColumn("image_class", E.image_class(F.col("unique_colors"), F.col("flatness"), F.col("extreme_ratio")))


def numbered(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Adds each row's place (from 0) in its group, in two levels: rows are sorted by range, and numbered inside their
    partition after the group's rows in partitions before it, so that no group is ever in one task."""
    laid = stored(rows.repartitionByRange(by, *order).withColumn("at_", F.spark_partition_id()))
    sums = laid.groupBy(by, "at_").agg(F.count(F.lit(1)).alias("n_"))
    ahead = F.coalesce(F.sum("n_").over(Window.partitionBy(by).orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col(by).alias("by_"), F.col("at_").alias("in_"), ahead.alias("ahead_"))
    inside = F.row_number().over(Window.partitionBy(by, "at_").orderBy(*order)) - 1
    made = laid.withColumn("row_", inside).join(starts, F.col(by).eqNullSafe(F.col("by_")) & (F.col("at_") == F.col("in_")))
    return made.withColumn(name, F.col("ahead_") + F.col("row_")).drop("at_", "by_", "in_", "ahead_", "row_")


def sample_stride(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / K.MAX_SAMPLES))
