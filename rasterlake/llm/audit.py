"""Filter interaction audit: what each of five filters removes, under every order of applying them.

Every document's failed filters are five bits. Documents meet the 120 orders (a broadcast table of fixed size), the
first filter of the order that a document fails is a column, and the five steps of the order are exploded; one
aggregation with map-side combining counts per part, order and step. What travels to it from a task is one row for
each part, order and step, whatever the number of documents.

The fifth filter looks across the table: a document fails it if its text is that of a smaller doc_id. Equal texts meet
by a 256-bit hash as one row with their least id, made with map-side combining; this goes back to the documents by a
join that Spark may split where a text is very frequent.

Defined results: a null text is empty, and equal to other null and empty texts; a document without an id fails the
fifth filter never, and has no labels; a null language is the part of the empty string. Rows that repeat an id are
documents of their own; of equal rows with one id none is a copy of the other. Labels that repeat an id count if any
row says so, null says nothing. A text is handled by itself and whole, so a long one takes memory in its task alone.
Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

FILTERS = "ABCDE"
#: Bit of each filter.
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
MIN_WORDS, MIN_DISTINCT, MOST_CAPITALS = 100, 80, 10
_CAPITALS, _SYMBOLS, _LATER_BYTES = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def text_flags(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    n, points = len(words), len(text.translate(None, _LATER_BYTES))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    failed = {
        "A": n < MIN_WORDS,
        "B": 100 * len(set(words)) < MIN_DISTINCT * n,
        "C": 100 * capitals > MOST_CAPITALS * points,
        "D": len(text) != len(text.translate(None, _SYMBOLS)),
    }
    return sum(BIT[f] for f, v in failed.items() if v)


def _flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, bits (A to D), sha (of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, sha = [], []
            for text in batch.column(2).cast(pa.binary()):
                text = text.as_py() or b""
                bits.append(text_flags(text))
                sha.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(sha, pa.binary())], names=["doc_id", "part", "bits", "sha"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, part string, bits int, sha binary")


def orders(spark: SparkSession) -> DataFrame:
    """filter_order and the bits of its five steps: 120 rows."""
    rows = [F.struct(F.lit("".join(p)).alias("filter_order"), *(F.lit(BIT[f]).alias(f"m{k}") for k, f in enumerate(p, 1))) for p in permutations(FILTERS)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits (A to E), good, toxic: one row for each document."""
    rows = Scratch(docs.sparkSession, "audit").put(_flags(docs), "flags")
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("sha").alias("same"), "first")
    rows = rows.join(first, F.col("sha") == F.col("same"), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    rows = rows.select("doc_id", "part", (F.col("bits") + F.when(copy, BIT["E"]).otherwise(0)).alias("bits"))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(said("quality").alias("good"), said("toxic").alias("toxic")).where("of is not null")
    rows = rows.join(known, F.col("doc_id") == F.col("of"), "left")
    return rows.select("part", "bits", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def replay(flags: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and counts, from part, bits, good, toxic of each document."""
    met = flags.crossJoin(F.broadcast(orders(flags.sparkSession)))
    fails = lambda k: F.col("bits").bitwiseAND(F.col(f"m{k}")) != 0
    first: Column = F.lit(6)
    for k in range(5, 0, -1):
        first = F.when(fails(k), k).otherwise(first)
    steps = F.posexplode(F.array(*(f"m{k}" for k in range(1, 6)))).alias("at", "mask")
    each = met.withColumn("first", first).select("part", "filter_order", "bits", "good", "toxic", "first", steps)
    step, here = F.col("at") + 1, F.col("first") == F.col("at") + 1
    counts = each.groupBy("part", "filter_order", step.alias("step"), "mask").agg(
        F.count_if(F.col("first") > step).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if((F.col("first") < step) & (F.col("bits").bitwiseAND(F.col("mask")) != 0)).alias("redundant"),
        F.count_if(F.col("bits") == F.col("mask")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    return counts


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and long counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley
    of `docs` (doc_id, text, lang) and `labels` (doc_id, quality, toxic): 600 rows for each part."""
    counts = Scratch(docs.sparkSession, "audit-counts").put(replay(flagged(docs, labels)), "counts")
    total = counts.groupBy(F.col("part").alias("of_part"), F.col("mask").alias("of_mask")).agg(F.sum("removed").alias("shapley"))
    made = counts.join(total, (F.col("part") == F.col("of_part")) & (F.col("mask") == F.col("of_mask")))
    return made.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
flags AS (SELECT doc_id, part, len(w) < 100 AS fa, 100 * len(list_distinct(w)) < 80 * len(w) AS fb,
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS fe FROM words),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    concat(CASE WHEN fa THEN 'A' ELSE '' END, CASE WHEN fb THEN 'B' ELSE '' END, CASE WHEN fc THEN 'C' ELSE '' END, CASE WHEN fd THEN 'D' ELSE '' END, CASE WHEN fe THEN 'E' ELSE '' END) AS f
    FROM flags LEFT JOIN said USING (doc_id)),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps(step) AS (VALUES (1), (2), (3), (4), (5)),
each AS (SELECT part, good, toxic, f, filter_order, step, substr(filter_order, step, 1) AS letter,
    list_min(list_transform(['A', 'B', 'C', 'D', 'E'], lambda x: CASE WHEN contains(f, x) THEN instr(filter_order, x) ELSE 6 END)) AS first
    FROM docs, orders, steps),
counts AS (SELECT part, filter_order, step, letter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
    count(*) FILTER (first < step AND contains(f, letter)) AS redundant, count(*) FILTER (f = letter) AS unique_fails,
    count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
    FROM each GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counts
"""
