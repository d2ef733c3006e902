"""Files as a stream: each micro-batch of new images goes through the same compression as a batch job does.

File listing is the only state. Results are written per batch under the batch's id, reports and contents apart, so a
batch that runs again after a failure replaces its own output, and reports can be read without the contents. Documents
go through compress_documents, pictures through compress_images; what is neither is left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import compress_documents
from ..operators.images import compress_images
from ..operators.stored import stored

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


#: What is taken in, by the end of its name.
PICTURES, DOCUMENTS = r"\.(png|bmp|jpe?g|gif)$", r"\.pdf$"


def compress_batch(files: DataFrame, min_ssim: float | None = None, max_dpi: float | None = None) -> DataFrame:
    """path, kind, status, technique, format_label, original_bytes, new_bytes, reduction_pct, content of pictures and
    documents."""
    name = F.lower("path")
    columns = ["path", "status", "technique", "format_label", "original_bytes", "new_bytes", "reduction_pct", "content"]
    pictures = compress_images(files.where(name.rlike(PICTURES)), min_ssim).select(F.lit("image").alias("kind"), *columns)
    documents = files.where(name.rlike(DOCUMENTS))
    if documents.isEmpty():
        return pictures
    return pictures.unionByName(compress_documents(documents, max_dpi).select(F.lit("pdf").alias("kind"), *columns))


def compress_stream(spark: SparkSession, source: str, out: str, checkpoint: str, min_ssim: float | None = None, files_per_batch: int = 1000, max_dpi: float | None = None, sink=None):
    """Starts the query; it handles what is there and ends (trigger availableNow). Every batch is written to
    out/reports/batch=N and out/contents/batch=N (path, content); `sink`, if given, is called with (rows, N) instead and
    must bear being called again with the same N."""
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(source)
    taken = files.where(F.lower("path").rlike(f"{PICTURES}|{DOCUMENTS}"))

    def write(batch: DataFrame, number: int) -> None:
        made = stored(compress_batch(batch, min_ssim, max_dpi))
        if sink is not None:
            sink(made, number)
            return
        made.drop("content").write.mode("overwrite").parquet(f"{out}/reports/batch={number}")
        made.where("content is not null").select("path", "content").write.mode("overwrite").parquet(f"{out}/contents/batch={number}")

    return taken.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
