"""Shared pieces of the training-data operators: table access, scratch tables, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`; also what bytes.split() cuts at.
WS = b" \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Spark's setting for the shuffle files of a finished execution.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the rows of a batch that goes to a Python worker, and what it becomes for whole documents.
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Intermediate tables written to the shared folder, so that a lost executor costs only its own tasks.

    put() writes and rereads a table; drop() removes one that later steps no longer read. Results are lazy and read
    what was put last, so that stays; Scratch.clear() removes what all operators of this driver left, once their
    results are written.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        Scratch.made.append(self)

    @classmethod
    def clear(cls) -> None:
        while cls.made:
            cls.made.pop().drop()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path, before = f"{self.root}/{name}", self.spark.conf.get(FILE_CLEANUP, "false")
        # the disks of many steps add up: Spark is to delete a step's shuffle files once its table is written
        self.spark.conf.set(FILE_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(FILE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = f"{self.root}/{name}" if name else self.root
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def one_thread(spark: SparkSession) -> None:
    """Matrix products of Python workers that start from now on use one thread: a task has one core, and more threads
    wait for each other in loops that burn it."""
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")


def few_rows(spark: SparkSession) -> None:
    """Whole documents go to Python workers BATCH_ROWS at a time from now on, unless the session names a number itself: a
    batch is held by the executor and by the worker, for every task that runs."""
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies: $TOKENIZER_DIR, else the installed package."""
    if os.environ.get("TOKENIZER_DIR"):
        return os.path.join(os.environ["TOKENIZER_DIR"], name)
    import public_tokenizers

    return public_tokenizers.path(name)
