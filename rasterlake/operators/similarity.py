"""Structural similarity over 8x8 tiles, and nearest palette entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as E


def tile_scores(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """One score per tile from pixel rows of both sides; keys name the pair and the tile. One pass, partial sums
    on the map side."""
    x, y = F.col(a), F.col(b)
    m = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sa"), F.sum(y).alias("sb"), F.sum(x * x).alias("saa"), F.sum(y * y).alias("sbb"), F.sum(x * y).alias("sab"))
    n = F.col("n")
    ma, mb = F.col("sa") / n, F.col("sb") / n
    va, vb, cov = F.col("saa") / n - ma * ma, F.col("sbb") / n - mb * mb, F.col("sab") / n - ma * mb
    top = (2 * ma * mb + F.lit(K.SSIM_C1)) * (2 * cov + F.lit(K.SSIM_C2))
    low = (ma * ma + mb * mb + F.lit(K.SSIM_C1)) * (va + vb + F.lit(K.SSIM_C2))
    return m.select(*keys, F.when(low == 0, 1.0).otherwise(top / low).alias("score"))


def whole_tiles(px: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Pixels (x, y) inside full windows, with the tile they are in."""
    w = K.SSIM_WINDOW
    inside = (F.col("x") < F.col(width) - F.col(width) % w) & (F.col("y") < F.col(height) - F.col(height) % w)
    return px.where(inside).withColumns({"tx": F.floor(F.col("x") / w), "ty": F.floor(F.col("y") / w)})


def ssim(pairs: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Mean over tiles; 1 for a pair without any."""
    mean = scores.groupBy(key).agg(F.avg("score").alias("ssim"))
    return pairs.join(mean, key, "left").withColumn("ssim", F.coalesce("ssim", F.lit(1.0)))


def resampled(px: DataFrame, sizes: DataFrame, image: str, value: str = "g") -> DataFrame:
    """(image, x, y, value) of images brought to other sizes: each new pixel is the mean of what it covers, by area,
    halves rounded up. `px` has (image, x, y, value), integers; `sizes` (image, w, h, to_w, to_h).

    A pixel gives its value, weighted by the overlap, to the few new pixels it touches; sums are of integers, so they
    are exact, and added up on the map side first."""
    at = px.join(sizes, image)

    def touched(place: str, size: str, to: str):
        # in units of 1 / (size * to) a pixel reaches from place * to to (place + 1) * to, a new one spans `size`
        low, high = F.col(place) * F.col(to), (F.col(place) + 1) * F.col(to)
        first, last = F.floor(low / F.col(size)), F.floor((high - 1) / F.col(size))
        part = lambda n: F.struct(n.alias("n"), (F.least(high, (n + 1) * F.col(size)) - F.greatest(low, n * F.col(size))).alias("w"))
        return F.transform(F.sequence(first, last), part)

    rows = at.select(image, "y", "h", "to_h", "w", value, F.explode(touched("x", "w", "to_w")).alias("i"))
    rows = rows.select(image, F.col("i.n").alias("x"), F.col("i.w").alias("wx"), "w", "h", value, F.explode(touched("y", "h", "to_h")).alias("j"))
    weighted = F.sum(F.col("wx") * F.col("j.w") * F.col(value)).alias("s")
    made = rows.groupBy(image, "x", F.col("j.n").alias("y")).agg(weighted, F.first(F.col("w").cast("long") * F.col("h")).alias("area"))
    return made.select(image, "x", "y", F.floor((2 * F.col("s") + F.col("area")) / (2 * F.col("area"))).cast("int").alias(value))


def compared(pairs: DataFrame, a: DataFrame, b: DataFrame, sizes_a: DataFrame, sizes_b: DataFrame) -> DataFrame:
    """(pair, ssim) of pairs (pair, a, b) of images, given as gray pixels (image, x, y, g) and sizes (image, w, h): both
    sides are brought to the first one's size, its long edge bounded, and the mean is taken over whole
    tiles; 1 without any."""
    size = pairs.join(sizes_a.select(F.col("image").alias("a"), F.col("w").alias("wa"), F.col("h").alias("ha")), "a")
    size = size.join(sizes_b.select(F.col("image").alias("b"), F.col("w").alias("wb"), F.col("h").alias("hb")), "b")
    to = [x.cast("long") for x in E.compare_dims(F.col("wa"), F.col("ha"))]
    size = size.withColumns({"to_w": to[0], "to_h": to[1]})

    def side(px: DataFrame, which: str, name: str) -> DataFrame:
        own = size.select("pair", F.col(which).alias("image"), F.col(f"w{which}").cast("long").alias("w"), F.col(f"h{which}").cast("long").alias("h"), "to_w", "to_h")
        rows = px.join(own.select("pair", "image"), "image").select("pair", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("g").cast("long").alias("g"))
        return resampled(rows, own.drop("image"), "pair").withColumnRenamed("g", name)

    met = side(a, "a", "ga").join(side(b, "b", "gb"), ["pair", "x", "y"]).join(size.select("pair", F.col("to_w").alias("width"), F.col("to_h").alias("height")), "pair")
    return ssim(pairs, tile_scores(whole_tiles(met), ["pair", "tx", "ty"], "ga", "gb"), "pair").select("pair", "ssim")


#: Palette entries that travel to every task at most: some 3 MB.
BROADCAST_ENTRIES = 1 << 16


def nearest(points: DataFrame, palette: DataFrame, id_col: str, dims: list[str], most: int = BROADCAST_ENTRIES) -> DataFrame:
    """(id, entry, distance): the palette entry of least squared distance, first of equals.

    A palette is counted first. One of up to `most` entries goes to every task as one array, scanned within the row; a
    larger one is cut into arrays of that size, a point meets each of them, and the best of these is its result."""
    n = palette.limit(most + 1).count()
    entry = F.struct(F.col("idx"), *(F.col(d).alias(f"p_{d}") for d in dims))
    blocks = 1 if n <= most else -(-palette.count() // most)
    entries = palette.groupBy(F.pmod(F.xxhash64("idx"), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("palette")).select("palette")

    def distance(e):
        parts = [(F.col(d) - e[f"p_{d}"]) * (F.col(d) - e[f"p_{d}"]) for d in dims]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return F.struct(total.alias("distance"), e["idx"].alias("entry"))

    best = F.array_min(F.transform("palette", distance)).alias("best")
    if blocks == 1:
        # the right side is exactly one row, of a size that was checked
        return points.join(F.broadcast(entries)).select(id_col, best).select(id_col, "best.entry", "best.distance")
    made = points.crossJoin(entries).select(id_col, best).groupBy(id_col).agg(F.min("best").alias("best"))
    return made.select(id_col, "best.entry", "best.distance")
