"""Files in and out: intake by media type, readers, and writers of archives and directories."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E

_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "avif": "image/avif", "svg": "image/svg+xml", "pdf": "application/pdf"}


def read_files(spark: SparkSession, path: str, images_only: bool = False, max_bytes: int | None = None) -> DataFrame:
    """path, name, mime, kind, length, content of the images and documents under a path. The size limit is
    pushed to the listing, so larger files are never opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    mime = F.create_map(*(F.lit(x) for kv in _TYPES.items() for x in kv))[F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))]
    files = files.withColumns({"name": name, "mime": mime}).withColumn("kind", E.media_kind(F.col("mime")))
    keep = F.col("kind") == "image" if images_only else F.col("kind").isNotNull()
    return files.where(keep).select("path", "name", "mime", "kind", "length", "content")


def decode_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, rgb (binary, row by row) by the JVM's decoders (PNG, JPEG, GIF, BMP); files that no
    decoder reads are told with a null raster."""
    raw = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    return raw.select(F.col("origin").alias("path"), F.when(F.col("width") > 0, F.col("width")).alias("width"), F.when(F.col("height") > 0, F.col("height")).alias("height"), F.col("nChannels").alias("channels"), F.when(F.col("width") > 0, F.col("data")).alias("bgr"))


def last_of_name(results: DataFrame, name: str, order: str) -> DataFrame:
    """One result per output name, the last; as an archive would keep them."""
    return results.groupBy(name).agg(F.max_by(F.struct(*(c for c in results.columns if c != name)), F.col(order)).alias("r")).select(name, "r.*")


def zip_archives(results: DataFrame, job: str, name: str, content: str, order: str) -> DataFrame:
    """(job, n, archive): one archive for each job, entries in order; a job of one file is that file alone, and a
    job is what one user put together, so it fits a task."""
    import pandas as pd

    last = results.groupBy(job, name).agg(F.max_by(F.struct(F.col(content).alias("c"), F.col(order).alias("o")), F.col(order)).alias("r")).select(F.col(job).alias("job"), F.col(name).alias("name"), "r.c", "r.o")
    kind = results.schema[job].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        if len(pdf) == 1:
            data = bytes(pdf["c"].iloc[0])
        else:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for n, c in zip(pdf["name"], pdf["c"], strict=True):
                    z.writestr(zipfile.ZipInfo(n), bytes(c))
            data = out.getvalue()
        return pd.DataFrame([(pdf["job"].iloc[0], len(pdf), data)], columns=["job", "n", "archive"])

    return last.groupBy("job").applyInPandas(pack, f"job {kind}, n int, archive binary")
