"""The corpus pipeline: toxicity, line dedup, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next
stage's documents. All but the last return the columns of `documents`.

1. toxicity: documents whose expected severity reaches REJECT_AT go. The model learns from `labels` and from
   the stage's own documents.
2. line_dedup: lines that equal, or are one edit from, an earlier line go; so does a document that had lines
   and has none left. n_chars follows the text.
3. near_duplicates: of each group of near duplicates (five words, 0.8) the row of the smallest doc_id stays, a
   row without an id only where no row has one. Rows are told apart by a hash of all their columns, so rows that
   share an id but not the text are documents of their own, and which of them stays doesn't depend on the run. Of
   equal rows one stays; rows without an id and without words all stay.
4. mixing: a document appears as often as the mix takes it, the one at the cut of its source whole.
5. tokens: ids and decoded text of every document, as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import bpe, jaccard, lines, mixing, toxicity
from rasterlake.llm.common import WORD, Scratch, few_rows, table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL expresses the fitted model of the first stage.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    made = toxicity.score(docs, model, carry=COLUMNS)
    return made.where(F.col("__severity") < toxicity.REJECT_AT).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = lines.dedup_lines(docs.select(*COLUMNS, (F.coalesce("text", F.lit("")) != "").alias("__had")))
    made = made.where(~F.col("__had") | (F.col("text") != ""))
    return made.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)).alias("__row"))
    found = jaccard.near_duplicates(rows.select("__row", "text"), id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row")))
    kept = found.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("__row"))
    unnamed = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(WORD)
    rows = rows.withColumn("__copy", F.when(unnamed, F.monotonically_increasing_id()))
    return rows.join(kept, "__row", "left_semi").dropDuplicates(["__row", "__copy"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # ids are nearly unique here, and the order is told by them alone
    return mixing.mixed_documents(docs, COLUMNS, by_text=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"), stored=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and reread."""
    scratch = Scratch(spark, "pipeline")
    few_rows(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
