"""Median-cut palettes over 15-bit colour histograms."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as E

_AXES = ("r", "g", "b")


def histogram(px: DataFrame, by: list[str]) -> DataFrame:
    """Counts per bin of r, g, b pixels; fully transparent ones, if there is an alpha, don't count."""
    if "a" in px.columns:
        px = px.where(F.col("a") > 0)
    return px.groupBy(*by, E.rgb_bin(F.col("r"), F.col("g"), F.col("b")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_bounds(bins: DataFrame, by: list[str]) -> DataFrame:
    axes = [f(E.bin_axis(F.col("bin"), k)).alias(f"{x}_{name}") for k, x in enumerate(_AXES) for f, name in ((F.min, "min"), (F.max, "max"))]
    return bins.groupBy(*by).agg(*axes, F.sum("n").alias("count"))


def split_once(bins: DataFrame, by: list[str]) -> DataFrame:
    """Splits each group of bins in two at the population median of its widest axis (red before green before
    blue): adds side 0 or 1. A group has at most 32768 bins. Groups of one bin stay whole."""
    b = box_bounds(bins, by)
    r, g, u = (F.col(f"{x}_max") - F.col(f"{x}_min") for x in _AXES)
    axis = F.when((r >= g) & (r >= u), 0).when(g >= u, 1).otherwise(2)
    rows = bins.join(b.select(*by, axis.alias("axis"), "count"), by)
    part = F.when(F.col("axis") == 0, E.bin_axis(F.col("bin"), 0)).when(F.col("axis") == 1, E.bin_axis(F.col("bin"), 1)).otherwise(E.bin_axis(F.col("bin"), 2))
    order = Window.partitionBy(*by).orderBy(part, "bin")
    group = Window.partitionBy(*by)
    rows = rows.withColumns({"pos": F.row_number().over(order) - 1, "run": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "bins": F.count(F.lit(1)).over(group)})
    reached = F.min(F.when(F.col("run") * 2 >= F.col("count"), F.col("pos"))).over(group)
    at = F.least(F.coalesce(reached, F.col("bins") - 1), F.col("bins") - 2)
    return rows.withColumn("side", F.when((F.col("bins") < 2) | (F.col("pos") <= at), 0).otherwise(1)).select(*by, "bin", "n", "axis", "side")


def means(bins: DataFrame, by: list[str]) -> DataFrame:
    """The population-weighted mean of bin centres."""
    size = 1 << (8 - K.BITS)
    centre = lambda k: (E.bin_axis(F.col("bin"), k) + F.lit(0.5)) * size * F.col("n")
    return bins.groupBy(*by).agg(*((F.sum(centre(k)) / F.sum("n")).alias(x) for k, x in enumerate(_AXES)), F.sum("n").alias("count"))


def cut(counts: dict[int, int], most: int) -> list[list[int]]:
    """Boxes of bins: the box with the largest spread by log of its population is split until there are `most`."""
    mask, bits = (1 << K.BITS) - 1, K.BITS
    axis_of = [lambda b, k=k: (b >> (bits * (2 - k))) & mask for k in range(3)]
    boxes = [sorted(counts)] if counts else []
    while len(boxes) < most:
        def score(box: list[int]) -> tuple[float, list[int]]:
            wide = [max(map(f, box)) - min(map(f, box)) for f in axis_of]
            return (max(wide) * math.log2(sum(counts[b] for b in box) + 1) if len(box) > 1 else 0.0), wide

        scored = [score(box) for box in boxes]
        at = max(range(len(boxes)), key=lambda j: (scored[j][0], -j), default=-1)
        if at < 0 or scored[at][0] <= 0:
            break
        wide = scored[at][1]
        box = sorted(boxes[at], key=axis_of[wide.index(max(wide))])
        half, run, last = sum(counts[b] for b in box) / 2, 0, len(box) - 2
        for j, b in enumerate(box):
            run += counts[b]
            if run >= half:
                last = min(j, last)
                break
        boxes[at : at + 1] = [box[: last + 1], box[last + 1 :]]
    return boxes


def quantize(hist: DataFrame, by: str, most: int) -> DataFrame:
    """(by, bin, box) of a full median cut. The loop is sequential, so it runs per image on its histogram, which
    is bounded at 32768 bins whatever the size of the image."""
    kind = hist.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = cut(dict(zip(pdf["bin"].astype(int), pdf["n"].astype(int), strict=True)), most)
        return pd.DataFrame([(pdf[by].iloc[0], b, k) for k, box in enumerate(boxes) for b in box], columns=[by, "bin", "box"])

    return hist.groupBy(by).applyInPandas(run, f"`{by}` {kind}, bin int, box int")
