"""Compression of documents over their object tables: equal images and fonts merged, images coded anew at the
resolution that their placement needs, the rest written together again.

A document's objects are rows; merging, placements, the plan and the exchange are joins and aggregations keyed by
(path, key), so documents of any number spread over the cluster and a large one spreads its images. Only the last
step brings the objects of one file together, to write it. Images are decoded and coded in Arrow tasks, one at a time;
a size target is searched for in rounds over all files at once, of which each codes the images of files still open at
their next values and adds up sizes.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as E
from ..sources import pdf
from . import docgraph
from .stored import stored

FONT_FILES = ("FontFile", "FontFile2", "FontFile3")


def merged(items: DataFrame) -> DataFrame:
    """(path, key, canonical): for items (path, key, ord, content) of a file, the first with the same bytes."""
    same = [F.length("content").alias("k_len"), F.sha2("content", 256).alias("k_sha")]
    named = items.select("path", "key", "ord", *same)
    first = named.groupBy("path", "k_len", "k_sha").agg(F.min_by("key", "ord").alias("canonical"))
    return named.join(first, ["path", "k_len", "k_sha"]).select("path", "key", "canonical")


def font_programs(objects: DataFrame) -> DataFrame:
    """The streams that descriptors name as font programs."""
    named = objects.select("path", F.explode("refs").alias("r")).where(F.col("r.entry").isin(*FONT_FILES)).select("path", F.col("r.dst").alias("key")).distinct()
    return objects.where("kind = 'stream'").join(named, ["path", "key"], "left_semi")


def redirected(objects: DataFrame, moves: DataFrame) -> DataFrame:
    """Objects whose references, at any depth of their values, go to `canonical` instead of `key` (path, key,
    canonical)."""
    moves = moves.where("key <> canonical").select(F.col("path").alias("at"), F.col("key").alias("was"), F.col("canonical").alias("now"))
    used = objects.select("path", "key", F.explode("refs").alias("r")).join(moves, (F.col("path") == F.col("at")) & (F.col("r.dst") == F.col("was")))
    used = used.groupBy(F.col("path").alias("of_path"), F.col("key").alias("of_key")).agg(F.collect_set(F.struct("was", "now")).alias("moves"))
    rows = objects.join(used, (F.col("path") == F.col("of_path")) & (F.col("key") == F.col("of_key")), "left").drop("of_path", "of_key")
    moved = F.col("moves").isNotNull()
    target = lambda dst: F.coalesce(F.get(F.filter("moves", lambda m: m["was"] == dst), F.lit(0))["now"], dst)

    @F.pandas_udf("array<string>")
    def changed(values: pd.Series, was: pd.Series, now: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else [x if x is None else pdf.readdressed(x, dict(zip(old, new, strict=True))) for x in v] for v, old, new in zip(values, was, now, strict=True)])

    # only what changes goes to Python, and no streams do
    told = F.when(moved, F.concat(F.map_values("dict"), F.array("body")))
    rows = rows.withColumn("told", changed(told, F.col("moves.was"), F.col("moves.now")))
    return rows.withColumns({
        "dict": F.when(moved, F.map_from_arrays(F.map_keys("dict"), F.slice("told", F.lit(1), F.size("dict")))).otherwise(F.col("dict")),
        "body": F.when(moved, F.element_at("told", -1)).otherwise(F.col("body")),
        "refs": F.when(moved, F.transform("refs", lambda r: F.struct(target(r["dst"]).alias("dst"), r["entry"].alias("entry")))).otherwise(F.col("refs")),
    }).drop("moves", "told")


def placements(pages: DataFrame, scope: str = "page") -> DataFrame:
    """(path, key, width_pt, height_pt) of each painted object, from (path, page, place, ops): the largest placement on
    the first page that paints it, or with `scope` document the largest in all."""
    where = pages.select(F.col("path").alias("of"), F.col("page").alias("at"), "place")
    paints = docgraph.page_paints(pages).join(where, (F.col("path") == F.col("of")) & (F.col("page") == F.col("at"))).drop("of", "at")
    return docgraph.placements(paints, scope).withColumnsRenamed({"width": "width_pt", "height": "height_pt"})


def scaled(w: int, h: int, ratio: float) -> tuple[int, int]:
    """Both sides by the ratio, but not below the least long edge, where the image has that many pixels."""
    edge = max(w, h)
    r = max(edge * ratio, min(edge, K.MIN_LONG_EDGE)) / edge
    return max(1, int(w * r + 0.5)), max(1, int(h * r + 0.5))


def plan(width: Column, height: Column, width_pt: Column, height_pt: Column, max_dpi: float) -> tuple[Column, Column, Column]:
    """(width, height, whether smaller) of an image under a resolution ceiling, from the pixels and points it has: the
    form of Picture.planned() over tables."""
    w, h = (x.cast("long") for x in E.page_image_dims(width, height, E.dpi_scale(E.effective_dpi(width, height, width_pt, height_pt), max_dpi)))
    return w, h, (w < width) | (h < height)


def estimated_size(baseline: Column, held: Column, coded: Column) -> Column:
    """Bytes of a file whose images take `coded` instead of `held`, from those of all of it rewritten; null counts as
    none."""
    return baseline - F.coalesce(held, F.lit(0)) + F.coalesce(coded, F.lit(0))


def allowed_size(most: Column) -> Column:
    """What an estimate may be for the file to be within `most`."""
    return most * F.lit(K.ESTIMATE_MARGIN)


class Picture:
    """One image of a document with its plan: size under the resolution ceiling, bilevel or not."""

    def __init__(self, px, w: int, h: int, bilevel: bool):
        self.px, self.w, self.h, self.bilevel = px, w, h, bilevel

    @classmethod
    def planned(cls, px, wide: float | None, high: float | None, max_dpi: float) -> Picture:
        h, w = px.shape[:2]
        dpi = max(w / wide, h / high) * 72 if wide and high else 0.0
        return cls(px, *scaled(w, h, max_dpi / dpi if dpi > max_dpi else 1.0), cls.is_bilevel(px))

    @staticmethod
    def is_bilevel(px) -> bool:
        from ..sources import rasters as R

        return R.classify(R.bounded(px, K.ANALYSE_EDGE))[0] == "bilevel"

    def coded(self, scale: float, quality: float) -> tuple[bytes, int, int, bool]:
        """(bytes, width, height, bilevel): a JPEG, or Group 4 if the image is bilevel and that is smaller."""
        from ..sources import jpeg
        from ..sources import rasters as R
        from . import g4

        w, h = scaled(self.w, self.h, scale)
        px = R.resized(self.px, w, h)
        best = jpeg.encode(px, quality)[0], w, h, False
        if self.bilevel:
            code = g4.encode(R.bilevel(px))
            best = (code, w, h, True) if len(code) < len(best[0]) else best
        return best


def largest_fit(size: Callable[[float], float], lo: float, hi: float, steps: int, most: float) -> float | None:
    """The largest of 2 ** steps even values from `lo` on (`hi` is none of them) whose size fits, for sizes that grow."""
    value = lambda k: lo + k * (hi - lo) / 2**steps
    n = bisect.bisect_right(range(2**steps), most, key=lambda k: size(value(k)))
    return value(n - 1) if n else None


#: Levels of objects below an image that may hold its colour space: the array, a palette's base, its profile.
SPACE_LEVELS = 3
#: Streams of a colour space that are read: palettes have some hundred bytes; a profile tells by its dictionary.
SPACE_BYTES = 1 << 16


def with_parts(images: DataFrame, objects: DataFrame) -> DataFrame:
    """Images with `parts`: the objects, by key, that their colour spaces refer to, through references of references."""
    wanted = images.select("path", F.col("key").alias("image"), F.explode("refs").alias("r")).where("r.entry = 'ColorSpace'").select("path", "image", F.col("r.dst").alias("key")).distinct()
    slim = objects.where("key <> 'trailer'").select("path", "key", "kind", "dict", "body", "refs", F.when(F.length("content") <= SPACE_BYTES, F.col("content")).alias("content"))
    found = None
    for level in range(SPACE_LEVELS):
        here = wanted.join(slim, ["path", "key"])
        part = here.select("path", "image", "key", F.struct("body", "dict", F.when(F.col("dict")["N"].isNull(), F.col("content")).alias("content")).alias("part"))
        found = part if found is None else found.unionByName(part)
        if level + 1 < SPACE_LEVELS:
            # a profile's stream names no more than another space to fall back on
            wanted = stored(here.where(F.col("dict")["N"].isNull()).select("path", "image", F.explode("refs").alias("r")).select("path", "image", F.col("r.dst").alias("key")).distinct())
    once = found.groupBy("path", "image", "key").agg(F.first("part").alias("part"))
    grouped = once.groupBy(F.col("path").alias("of_path"), F.col("image").alias("of_key")).agg(F.map_from_entries(F.collect_list(F.struct("key", "part"))).alias("parts"))
    return images.join(grouped, (F.col("path") == F.col("of_path")) & (F.col("key") == F.col("of_key")), "left").drop("of_path", "of_key")


def _decoded(r) -> tuple[object, str | None]:
    """(pixels, None) of an image's row, or (None, why it is left out)."""
    parts = {k: ((p["body"] or "").encode("latin-1"), dict(p["dict"] or {}), None if p["content"] is None else bytes(p["content"])) for k, p in dict(r.parts or {}).items()}
    try:
        return pdf.raster(dict(r.dict), bytes(r.content), parts), None
    except pdf.LeftOut as e:
        return None, str(e)


_PICTURE = ("path", "key", "dict", "content", "width_pt", "height_pt", "parts")
_CODED = "path string, key string, content binary, width int, height int, bilevel boolean, native_width int, native_height int, base_width int, base_height int, why string"
_CODED_NAMES = [f.split()[0] for f in _CODED.split(", ")]


def _points(r) -> tuple[float | None, float | None]:
    return tuple(float(x) if x is not None and x == x and x > 0 else None for x in (r.width_pt, r.height_pt))


def coded_images(images: DataFrame, max_dpi: float, quality: float = K.VISUAL_QUALITY) -> DataFrame:
    """Images (path, key, dict, content, width_pt, height_pt, parts) coded at one quality; one that isn't decoded has
    no content, and `why`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                px, why = _decoded(r)
                if px is None:
                    row = (r.path, r.key, *[None] * 8, why)
                else:
                    p = Picture.planned(px, *_points(r), max_dpi)
                    row = (r.path, r.key, *p.coded(1.0, quality), px.shape[1], px.shape[0], p.w, p.h, None)
                yield pd.DataFrame([row], columns=_CODED_NAMES)

    return images.select(*_PICTURE).mapInPandas(run, _CODED)


_RASTERS = "path string, key string, salt int, held long, px binary, native_width int, native_height int, width_pt double, height_pt double, bilevel boolean, why string"
#: Images of a file that one task codes in a round, about; parts of a file at most.
SHARE, MOST_SHARES = 8, 64


def decoded_images(images: DataFrame, max_dpi: float) -> DataFrame:
    """Every image's pixels (deflated) and plan. Images are dealt by themselves, whatever file they are of; `salt` deals
    those of a file of many to several keys."""
    names = [f.split()[0] for f in _RASTERS.split(", ")]
    tasks = max(1, int(images.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    counts = images.groupBy("path").agg(F.least(F.lit(MOST_SHARES), F.ceil(F.count(F.lit(1)) / SHARE)).cast("int").alias("shares"))
    dealt = images.select(*_PICTURE).join(counts, "path").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int")).repartition(tasks, "path", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                px, why = _decoded(r)
                if px is None:
                    row = (r.path, r.key, r.salt, len(r.content), *[None] * 6, why)
                else:
                    row = (r.path, r.key, r.salt, len(r.content), zlib.compress(px.tobytes(), 1), px.shape[1], px.shape[0], *_points(r), Picture.is_bilevel(px), None)
                yield pd.DataFrame([row], columns=names)

    made = dealt.mapInPandas(run, _RASTERS)
    w, h, _ = plan(*map(F.col, ("native_width", "native_height", "width_pt", "height_pt")), max_dpi)
    return made.withColumns({"base_width": w.cast("int"), "base_height": h.cast("int")}).drop("width_pt", "height_pt")


def _coded_at(rasters: DataFrame, values: DataFrame, keep: bool) -> DataFrame:
    """The images of the files in `values` (path, shares, scale, quality) coded at these: whole rows, or sizes only."""
    each = values.select("path", "scale", "quality", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"))
    schema = _CODED if keep else "path string, size long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                px = np.frombuffer(zlib.decompress(r.px), np.uint8).reshape(r.native_height, r.native_width, 3)
                made = Picture(px, r.base_width, r.base_height, r.bilevel).coded(r.scale, r.quality)
                row = (r.path, r.key, *made, r.native_width, r.native_height, r.base_width, r.base_height, None) if keep else (r.path, len(made[0]))
                yield pd.DataFrame([row], columns=names)

    return rasters.where("px is not null").join(each, ["path", "salt"]).mapInPandas(run, schema)


def searched(probe: Callable[[DataFrame], DataFrame], state: DataFrame) -> DataFrame:
    """path, shares, scale, quality of each file of `state` (path, shares, room): the largest scale at a good quality
    whose size, as `probe` tells (path, size) of (path, shares, scale, quality), is within `room`; or else the best
    quality at the least scale, or the least.

    Every file halves its own interval; a round probes all that are still open, and their state is one table."""
    scales, qualities = 2**K.TARGET_SCALE_STEPS, 2**K.TARGET_QUALITY_STEPS
    even = lambda k, lo, hi, n: F.lit(lo) + k * F.lit((hi - lo) / n)
    by_scale = F.col("phase") == 0

    def values(k: Column) -> list[Column]:
        scale = F.when(by_scale, even(k, K.LEAST_SCALE, 1.0, scales)).otherwise(F.lit(K.LEAST_SCALE))
        quality = F.when(by_scale, F.lit(K.TARGET_QUALITY)).otherwise(even(k, K.LEAST_QUALITY, K.TARGET_QUALITY, qualities))
        return [scale.alias("scale"), quality.alias("quality")]

    state = stored(state.select("path", "shares", "room", F.lit(0).alias("phase"), F.lit(0).alias("low"), F.lit(scales).alias("high")))
    for _ in range(K.TARGET_SCALE_STEPS + K.TARGET_QUALITY_STEPS + 2):
        open_ = state.where("low < high")
        if open_.isEmpty():
            break
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        sizes = probe(open_.select("path", "shares", *values(mid)))
        state = state.join(sizes, "path", "left")
        fits = F.col("size") <= F.col("room")
        state = state.select("path", "shares", "room", "phase", F.when(F.col("size").isNotNull() & fits, mid + 1).otherwise(F.col("low")).alias("low"), F.when(F.col("size").isNotNull() & ~fits, mid).otherwise(F.col("high")).alias("high"))
        # no scale fits: on to the qualities
        none = by_scale & (F.col("high") == 0)
        state = stored(state.select("path", "shares", "room", F.when(none, 1).otherwise(F.col("phase")).alias("phase"), "low", F.when(none, F.lit(qualities)).otherwise(F.col("high")).alias("high")))
    return state.select("path", "shares", *values(F.greatest(F.col("low") - 1, F.lit(0))))


def fitted_images(images: DataFrame, sizes: DataFrame, target_bytes: int) -> DataFrame:
    """The images of each file coded so that the file fits: the largest scale at a good quality, or else the best
    quality at the least scale. `sizes` (path, length, baseline): bytes of the file, and of all of it rewritten."""
    rasters = stored(decoded_images(images.join(sizes.select("path"), "path", "left_semi"), K.DPI_PRESETS[1]))
    held = rasters.where("px is not null").groupBy("path").agg(F.sum("held").alias("held"), (F.max("salt") + 1).alias("shares"))
    most = allowed_size(F.least(F.lit(target_bytes), F.col("length")))
    state = sizes.join(held, "path").select("path", "shares", (most - estimated_size(F.col("baseline"), F.col("held"), F.lit(0))).alias("room"))
    chosen = searched(lambda values: _coded_at(rasters, values, False).groupBy("path").agg(F.sum("size").alias("size")), state)
    left_out = rasters.where("px is null").select("path", "key", *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _CODED.split(", ")[2:-1]), "why")
    return _coded_at(rasters, chosen, True).unionByName(left_out)


def exchanged(objects: DataFrame, coded: DataFrame) -> DataFrame:
    """Objects with the coded images in the place of theirs."""
    made = coded.select(F.col("path").alias("of_path"), F.col("key").alias("of_key"), F.col("content").alias("new"), "width", "height", "bilevel")
    rows = objects.join(made, (F.col("path") == F.col("of_path")) & (F.col("key") == F.col("of_key")), "left")
    w, h = F.col("width").cast("string"), F.col("height").cast("string")
    coded_parms = F.concat(F.lit("<< /K -1 /Columns "), w, F.lit(" /Rows "), h, F.lit(" /BlackIs1 false /EncodedByteAlign false >>"))
    own = {"Width": w, "Height": h, "DecodeParms": coded_parms}
    entry = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), own.get(k, F.lit(v)))))
    new = F.when(F.col("bilevel"), entry(pdf.bilevel_image(0, 0))).otherwise(entry(pdf.jpeg_image(0, 0)))
    swapped = F.col("new").isNotNull()
    nothing = F.array().cast("array<struct<dst:string,entry:string>>")
    rows = rows.withColumns({"dict": F.when(swapped, new).otherwise(F.col("dict")), "content": F.coalesce("new", "content"), "refs": F.when(swapped, nothing).otherwise(F.col("refs"))})
    return rows.drop("of_path", "of_key", "new", "width", "height", "bilevel")


def assembled(objects: DataFrame) -> DataFrame:
    """(path, pdf, broken): every file of the objects that its trailer reaches, or why it can't be written. A file is
    what one task writes."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        found, trailer, made, broken = {}, {}, None, None
        try:
            for r in rows.sort_values("ord").itertuples(index=False):
                if r.kind == "trailer":
                    trailer = dict(r.dict)
                else:
                    body = r.body.encode("latin-1") if r.kind == "other" else pdf._dictionary(dict(r.dict))
                    found[r.key] = (body, bytes(r.content) if r.kind == "stream" else None)
            made = pdf.write(found, trailer)
        except (ValueError, KeyError, IndexError, OverflowError, AttributeError, TypeError) as e:
            broken = str(e)[:200]
        return pd.DataFrame([(rows["path"].iloc[0], made, broken)], columns=["path", "pdf", "broken"])

    return objects.groupBy("path").applyInPandas(build, "path string, pdf binary, broken string")


def compress_documents(files: DataFrame, max_dpi: float | None = None, target_bytes: int | None = None, scope: str = "page") -> DataFrame:
    """path, status, technique, format_label, counts, sizes, hit_target, content of each document (path, content).

    `scope` says which placement of an image counts, as in placements(). With `target_bytes` the images are fitted to the size, otherwise coded for `max_dpi`. A file that gets no smaller
    stays as it is, and so does one that can't be read, with its error as status. Pages aren't rendered, so a target
    that images alone can't reach is told as not hit. Images that aren't decoded stay as they are; `left_out` counts
    them and `left_out_images` tells of each why.
    """
    dpi = float(max_dpi or K.DPI_PRESETS[0])
    files = files.select("path", "content")
    read = stored(pdf.objects(files))
    errors = read.where("error is not null").select("path", "error")
    rows = docgraph.strip_metadata(read.where("error is null").drop("error"))
    images = docgraph.candidate_images(rows)
    same_images, same_fonts = merged(images), merged(font_programs(rows))
    moves = stored(same_images.withColumn("what", F.lit("image")).unionByName(same_fonts.withColumn("what", F.lit("font"))))
    rows = stored(redirected(rows, moves.drop("what")))
    kept = moves.where("what = 'image' and key = canonical").select("path", "key")
    # what is painted under the name of a merged image is the one that stays
    pages_ = pdf.page_operators(files)
    where = pages_.select(F.col("path").alias("of"), F.col("page").alias("at"), "place")
    paints = docgraph.page_paints(pages_).join(where, (F.col("path") == F.col("of")) & (F.col("page") == F.col("at"))).drop("of", "at")
    paints = paints.join(moves.select("path", F.col("key").alias("obj"), "canonical"), ["path", "obj"], "left").withColumn("obj", F.coalesce("canonical", "obj"))
    placed = docgraph.placements(paints, scope).withColumnsRenamed({"width": "width_pt", "height": "height_pt"})
    images = with_parts(rows.join(kept, ["path", "key"], "left_semi").join(placed, ["path", "key"], "left"), rows)
    sizes = files.select("path", F.length("content").cast("long").alias("length"))
    if target_bytes is None:
        coded = stored(coded_images(images, dpi))
    else:
        baseline = assembled(rows).select("path", F.length("pdf").cast("long").alias("baseline"))
        coded = stored(fitted_images(images, sizes.join(baseline, "path").where(F.col("length") > target_bytes), target_bytes))
    made = assembled(exchanged(rows, coded.where("content is not null")))
    left_out = coded.where("content is null").groupBy("path").agg(F.count(F.lit(1)).alias("left_out"), F.array_sort(F.collect_list(F.struct("key", "why"))).alias("left_out_images"))
    coded = coded.where("content is not null")
    merged_counts = moves.where("key <> canonical").groupBy("path").agg(F.count_if(F.col("what") == "image").alias("merged_images"), F.count_if(F.col("what") == "font").alias("merged_fonts"))
    smaller = (F.col("base_width") < F.col("native_width")) | (F.col("base_height") < F.col("native_height"))
    image_counts = coded.groupBy("path").agg(F.count(F.lit(1)).alias("images"), F.count_if(smaller).alias("downsampled"), F.count_if("bilevel").alias("bilevel"))
    pages = read.where(F.col("dict")["Type"] == "/Page").groupBy("path").agg(F.count(F.lit(1)).alias("pages"))
    all_ = files.select("path", "content", F.length("content").cast("long").alias("original_bytes"))
    for more in (made, merged_counts, image_counts, left_out, pages, errors):
        all_ = all_.join(more, "path", "left")
    n = F.length("pdf").cast("long")
    fine = F.lit(True) if target_bytes is None else F.col("original_bytes") > target_bytes
    better = F.coalesce(fine & (n < F.col("original_bytes")), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    some = F.coalesce("images", F.lit(0)) > 0
    technique = F.when(~better, "untouched").when(F.coalesce("bilevel", F.lit(0)) > 0, "pdf-bilevel").when(some, "pdf-images").otherwise("pdf-structure")
    label = F.when(technique == "pdf-bilevel", "CCITT G4 + JPEG").when(technique == "pdf-images", "JPEG").otherwise("PDF")
    new = F.when(better, n).otherwise(F.col("original_bytes"))
    hit = F.lit(None).cast("boolean") if target_bytes is None else new <= target_bytes
    status = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).when(F.col("broken").isNotNull(), F.concat(F.lit("error: "), "broken")).otherwise("done")
    counts = [zero(c) for c in ("pages", "merged_images", "merged_fonts", "images", "downsampled", "bilevel", "left_out")]
    counts.append(F.coalesce("left_out_images", F.array().cast("array<struct<key:string,why:string>>")).alias("left_out_images"))
    return all_.select("path", status.alias("status"), technique.alias("technique"), label.alias("format_label"), *counts, "original_bytes", new.alias("new_bytes"), E.reduction_pct(F.col("original_bytes"), new).alias("reduction_pct"), hit.alias("hit_target"), F.when(better, F.col("pdf")).otherwise(F.col("content")).alias("content"))
