"""Budget and floor searches, and picks of the smallest result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def grid(lo: float, hi: float, steps: int) -> Column:
    """Every value that a bisection of so many steps can test, in order; `hi` is none of them."""
    n = 2**steps
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(lo) + k * F.lit((hi - lo) / n))


def fit(rows: DataFrame, measure: Callable[[Column], Column], lo: float, hi: float, steps: int, target: Column) -> DataFrame:
    """Adds `fits` and `value`: the largest grid value whose measure is within target, for a measure that grows
    with the value; `lo` if none fits. Evaluated inside the row, without a shuffle."""
    best = F.array_max(F.filter(grid(lo, hi, steps), lambda v: measure(v) <= target))
    return rows.withColumn("fits", best.isNotNull()).withColumn("value", F.coalesce(best, F.lit(lo)))


def shrink_steps(w: Column, h: Column) -> Column:
    """Sizes tried without a quality to tune: 0.82 of each side, rounded, again and again while both stay at 16
    or more. Rounding compounds, so the sizes are folded."""
    first = F.struct(w.cast("long").alias("w"), h.cast("long").alias("h"))
    grow = lambda acc, _: F.array_append(acc, F.struct(*(F.floor(F.element_at(acc, -1)[x] * F.lit(K.SHRINK) + F.lit(0.5)).alias(x) for x in "wh")))
    every = F.aggregate(F.sequence(F.lit(1), F.lit(K.SHRINK_ATTEMPTS - 1)), F.array(first), grow)
    # sizes only get smaller, so what follows one that is too small is too small as well; the first is always tried
    return F.filter(every, lambda s, i: (i == 0) | ((s["w"] >= K.MIN_DIMENSION) & (s["h"] >= K.MIN_DIMENSION)))


def smallest(rows: DataFrame, keys: list[str], size: str, order: list[str], *carry: str) -> DataFrame:
    """The smallest candidate per key, the first in `order` of equals. A pre-aggregated minimum, no sort."""
    best = F.min_by(F.struct(*carry, size), F.struct(size, *order))
    return rows.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def until_failure(rows: DataFrame, keys: list[str], ord_col: str, passed: str) -> DataFrame:
    """Candidates tried in order up to the first that fails."""
    first = rows.where(~F.col(passed)).groupBy(*keys).agg(F.min(ord_col).alias("stop_"))
    return rows.join(first, keys, "left").where(F.col("stop_").isNull() | (F.col(ord_col) < F.col("stop_"))).drop("stop_")
