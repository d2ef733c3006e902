"""Queries that run the work on files (documents, images) over pictures made from the given tables: `embeddings` as
8x8 gray tiles of larger pictures. SQL says what is exact of their results; coded sizes belong to the coders' tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import docgraph, documents, images, similarity
from ..sources import pdf, rasters
from .oracle import _PX

#: Tiles across a picture, pictures of a document, times a pixel is repeated in documents, and the documents' target.
ACROSS, PICTURES, ZOOM, TARGET = 8, 4, 4, 60_000


def _tiles(spark, sf_dir: str, across: int) -> DataFrame:
    """image, place, grays (binary of 64): tiles of pictures of across by across tiles, in order of vec_id."""
    n = across * across
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    grays = F.transform("embedding", E.gray_of_unit)
    return v.select(F.floor(F.col("vec_id") / n).cast("long").alias("image"), F.pmod("vec_id", F.lit(n)).cast("int").alias("place"), grays.alias("grays"))


def _picture(rows: pd.DataFrame, across: int) -> np.ndarray:
    """(8 across, 8 across) grays; tiles that are missing are black."""
    px = np.zeros((across, across, 8, 8), np.uint8)
    for place, grays in zip(rows["place"], rows["grays"], strict=True):
        px[place // across, place % across] = np.asarray(grays, np.uint8).reshape(8, 8)
    return px.transpose(0, 2, 1, 3).reshape(8 * across, 8 * across)


def picture_files(spark, sf_dir: str, across: int = ACROSS) -> DataFrame:
    """path, content: a bitmap file of every picture."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        px = np.repeat(_picture(rows, across)[..., None], 3, axis=2)
        return pd.DataFrame([(f"p{rows['image'].iloc[0]}.bmp", rasters.encode_bmp(px))], columns=["path", "content"])

    return _tiles(spark, sf_dir, across).groupBy("image").applyInPandas(build, "path string, content binary")


def document_files(spark, sf_dir: str, across: int = ACROSS) -> DataFrame:
    """path, content: documents of up to PICTURES pictures, one page each, as they would be scanned: not coded, one of
    them by a palette that the page's colour space refers to, one painted twice."""
    pictures = _tiles(spark, sf_dir, across).withColumn("file", F.floor(F.col("image") / PICTURES))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        found, kids = {"1_0": (b"<< /Type /Catalog /Pages 2 0 R >>", None)}, []
        for n, (_, some) in enumerate(rows.groupby("image", sort=True)):
            px = np.repeat(np.repeat(_picture(some, across), ZOOM, axis=0), ZOOM, axis=1)
            page, image, content, space = (10 + 10 * n + k for k in range(4))
            name = b"/DeviceGray" if n % 2 == 0 else b"%d 0 R" % space
            found[f"{page}_0"] = (b"<< /Type /Page /Parent 2 0 R /Resources << /XObject << /Im %d 0 R >> >> /Contents %d 0 R >>" % (image, content), None)
            found[f"{image}_0"] = (b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent 8 >>" % (px.shape[1], px.shape[0], name), px.tobytes())
            found[f"{content}_0"] = (b"<< >>", b"q 300 0 0 300 0 0 cm /Im Do Q q 100 0 0 100 0 0 cm /Im Do Q")
            if n % 2:
                found[f"{space}_0"] = (b"[/Indexed /DeviceGray 255 <" + bytes(range(256)).hex().encode() + b">]", None)
            kids.append(b"%d 0 R" % page)
        found["2_0"] = (b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids), None)
        return pd.DataFrame([(f"f{rows['file'].iloc[0]}.pdf", pdf.write(found, {"Root": "1 0 R"}))], columns=["path", "content"])

    return pictures.groupBy("file").applyInPandas(build, "path string, content binary")


def fit_documents(spark, sf_dir):
    made = documents.compress_documents(document_files(spark, sf_dir), target_bytes=TARGET)
    return made.select("path", "status", "pages", "images", "left_out", "hit_target", (F.col("new_bytes") <= F.col("original_bytes")).alias("not_larger"))


def sample_documents(spark, sf_dir):
    """For a resolution instead of a size: 256 pixels on 300 points are some 61 dpi, so that 30 dpi ask for the least
    long edge."""
    made = documents.compress_documents(document_files(spark, sf_dir), max_dpi=30)
    return made.select("path", "status", "pages", "images", "downsampled", "left_out", "merged_images")


def compress_pictures(spark, sf_dir):
    made = images.compress_images(picture_files(spark, sf_dir))
    return made.select("path", "status", "image_class", "original_bytes", "width", "height", (F.col("new_bytes") < F.col("original_bytes")).alias("smaller"))


def optimise_pictures(spark, sf_dir):
    """The lossless form of every picture is read again and compared with the picture: pixels that differ."""
    files = picture_files(spark, sf_dir)
    made = images.optimise_images(files).select("path", "status", "original_bytes", "steps", F.col("content").alias("made"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            differ = [int((rasters.decode(m)[..., :3] != rasters.decode(c)[..., :3]).sum()) for m, c in zip(rows["made"], rows["content"], strict=True)]
            falls = [all(a["bytes"] >= b["bytes"] for a, b in zip(s, s[1:], strict=False)) for s in rows["steps"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(differ, pa.int64()), pa.array(falls, pa.bool_())], names=["path", "status", "original_bytes", "differing", "falls"])

    both = made.join(files, "path").select("path", "status", "original_bytes", "steps", "made", "content")
    return both.mapInArrow(compare, "path string, status string, original_bytes long, differing long, falls boolean")


def image_ssim(spark, sf_dir):
    """Pictures of 4 by 4 tiles, cut to several sizes (some below a window), against the next one of full size."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    tile = F.pmod("vec_id", F.lit(16))
    px = v.select(F.floor(F.col("vec_id") / 16).cast("long").alias("image"), (F.pmod(tile, F.lit(4)) * 8 + F.pmod("p", F.lit(8))).alias("x"), (F.floor(tile / 4) * 8 + F.floor(F.col("p") / 8)).alias("y"), E.gray_of_unit(F.col("v")).alias("g"))
    image = F.col("image")
    sizes = px.select("image").distinct().select("image", *(F.when(image % 7 == 0, 6).otherwise(8 * (1 + (image + k) % 4)).cast("long").alias(c) for k, c in enumerate("wh")))
    cut = px.join(sizes, "image").where("x < w and y < h").select("image", "x", "y", "g")
    full = px.select("image").distinct().select("image", F.lit(32).cast("long").alias("w"), F.lit(32).cast("long").alias("h"))
    pairs = sizes.select(image.alias("pair"), image.alias("a"), (image + 1).alias("b")).join(full.select(image.alias("b")), "b", "left_semi")
    return similarity.compared(pairs, cut, px, sizes, full).select("pair", F.round("ssim", 9).alias("ssim"))


def placement_scopes(spark, sf_dir):
    """Orders as documents, their lines as pages that paint a part each: the largest on the first page, or of all."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    number = F.col("l_linenumber").cast("int")
    paints = lines.select(F.col("l_suppkey").cast("string").alias("path"), F.floor(F.col("l_orderkey") / 64).cast("int").alias("place"), (F.pmod("l_orderkey", F.lit(64)).cast("int") * 100000 + number * 10000 + F.pmod("l_partkey", F.lit(10000)).cast("int")).alias("seq"), F.pmod("l_partkey", F.lit(5)).cast("string").alias("obj"), (F.col("l_quantity") - 3).cast("double").alias("width"), F.col("l_quantity").cast("double").alias("height"))
    one = lambda scope: docgraph.placements(paints, scope).select("path", "key", F.lit(scope).alias("scope"), "width", "height")
    return one("page").unionByName(one("document"))


NAMES = (fit_documents, sample_documents, compress_pictures, optimise_pictures, image_ssim, placement_scopes)
QUERIES = {f.__name__: f for f in NAMES}

_PICTURES = f"SELECT vec_id // {ACROSS * ACROSS} AS image FROM embeddings"
_FILES = f"SELECT 'f' || (image // {PICTURES}) || '.pdf' AS path, count(DISTINCT image) AS n FROM ({_PICTURES}) GROUP BY 1"
_SIDE = 8 * ACROSS
_TILE = """t AS (SELECT vec_id // 16 AS image, (vec_id % 16) % 4 * 8 + p % 8 AS x, (vec_id % 16) // 4 * 8 + p // 8 AS y, g::BIGINT AS g FROM px),
sz AS (SELECT DISTINCT image, CASE WHEN image % 7 = 0 THEN 6 ELSE 8 * (1 + image % 4) END AS w, CASE WHEN image % 7 = 0 THEN 6 ELSE 8 * (1 + (image + 1) % 4) END AS h FROM t),
pr AS (SELECT image AS pair, w, h FROM sz WHERE image + 1 IN (SELECT image FROM sz)),
bx AS (SELECT pair, w, h, ox, t.y, sum((least((t.x + 1) * w, (ox + 1) * 32) - greatest(t.x * w, ox * 32)) * g) AS s
  FROM pr JOIN t ON t.image = pair + 1, unnest(range(w)) u(ox) WHERE greatest(t.x * w, ox * 32) < least((t.x + 1) * w, (ox + 1) * 32) GROUP BY ALL),
bb AS (SELECT pair, w, h, ox, oy, sum((least((bx.y + 1) * h, (oy + 1) * 32) - greatest(bx.y * h, oy * 32)) * s) AS s
  FROM bx, unnest(range(h)) u(oy) WHERE greatest(bx.y * h, oy * 32) < least((bx.y + 1) * h, (oy + 1) * 32) GROUP BY ALL),
m AS (SELECT pair, ox // 8 AS tx, oy // 8 AS ty, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab FROM (
  SELECT pair, ox, oy, t.g AS a, (2 * s + 1024)::BIGINT // 2048 AS b FROM bb JOIN t ON t.image = pair AND t.x = ox AND t.y = oy WHERE ox < w - w % 8 AND oy < h - h % 8) GROUP BY ALL),
q AS (SELECT pair, sa::DOUBLE / n AS ma, sb::DOUBLE / n AS mb, saa::DOUBLE / n AS xa, sbb::DOUBLE / n AS xb, sab::DOUBLE / n AS xy FROM m),
sc AS (SELECT pair, ((2 * ma * mb + 6.5025::DOUBLE) * (2 * (xy - ma * mb) + 58.5225::DOUBLE)) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * ((xa - ma * ma) + (xb - mb * mb) + 58.5225::DOUBLE)) AS score FROM q)"""
_PLACED = "SELECT l_suppkey::VARCHAR AS path, (l_partkey % 5)::VARCHAR AS key, l_orderkey // 64 AS place, l_orderkey % 64 * 100000 + l_linenumber * 10000 + l_partkey % 10000 AS seq, (l_quantity - 3)::DOUBLE AS width, l_quantity::DOUBLE AS height FROM lineitem"

ORACLE_SQL: dict[str, str] = {
    "fit_documents": f"SELECT path, 'done' AS status, n AS pages, n AS images, 0::BIGINT AS left_out, true AS hit_target, true AS not_larger FROM ({_FILES})",
    "sample_documents": f"SELECT path, 'done' AS status, n AS pages, n AS images, n AS downsampled, 0::BIGINT AS left_out, 0::BIGINT AS merged_images FROM ({_FILES})",
    "compress_pictures": f"""WITH {_PX}, g AS (SELECT image, y, x, coalesce(g, 0) AS g FROM (SELECT DISTINCT image FROM ({_PICTURES})), unnest(range({_SIDE})) a(y), unnest(range({_SIDE})) b(x)
  LEFT JOIN px ON px.vec_id = image * {ACROSS * ACROSS} + y // 8 * {ACROSS} + x // 8 AND px.p = y % 8 * 8 + x % 8),
l AS (SELECT *, 0.299::DOUBLE * g + 0.587::DOUBLE * g + 0.114::DOUBLE * g AS luma, lag(g) OVER (PARTITION BY image ORDER BY y, x) AS before FROM g),
a AS (SELECT image, count(DISTINCT g) AS n, count(*) FILTER (g = before)::DOUBLE / count(*) AS flatness, count(*) FILTER (luma <= 40 OR luma >= 215)::DOUBLE / count(*) AS extreme FROM l GROUP BY image)
SELECT 'p' || image || '.bmp' AS path, 'done' AS status, CASE WHEN extreme >= 0.9 THEN 'bilevel' WHEN flatness >= 0.45 THEN 'flat' ELSE 'photo' END AS image_class, {54 + _SIDE * _SIDE * 3}::BIGINT AS original_bytes, {_SIDE}::INT AS width, {_SIDE}::INT AS height, true AS smaller FROM a""",
    "optimise_pictures": f"SELECT 'p' || image || '.bmp' AS path, 'done' AS status, {54 + _SIDE * _SIDE * 3}::BIGINT AS original_bytes, 0::BIGINT AS differing, true AS falls FROM (SELECT DISTINCT image FROM ({_PICTURES}))",
    "image_ssim": f"WITH {_PX}, {_TILE} SELECT pair, round(coalesce((SELECT avg(score) FROM sc WHERE sc.pair = pr.pair), 1.0), 9) AS ssim FROM pr",
    "placement_scopes": f"""WITH p AS ({_PLACED}), f AS (SELECT path, key, min(place) AS place FROM p GROUP BY path, key),
b AS (SELECT path, key, 'document' AS scope, max(struct_pack(a := width * height, p := -place, s := -seq, w := width, h := height)) AS m FROM p GROUP BY path, key
UNION ALL SELECT path, key, 'page', max(struct_pack(a := width * height, p := -place, s := -seq, w := width, h := height)) FROM p JOIN f USING (path, key, place) GROUP BY path, key)
SELECT path, key, scope, m.w AS width, m.h AS height FROM b WHERE m.w > 0 AND m.h > 0""",
}
