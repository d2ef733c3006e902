"""Mixing sources to target weights, by DataFrame functions only.

Every document gets a random key, a hash of its id and text. Within each source documents are ordered by that key;
running sums of their sizes are cut at the source's budget, after as many whole passes as the budget holds.

Running sums are made in two levels, so that no source is ever in one task: the key's leading digits cut each
source into BUCKETS ranges; a small table of sums for (source, range) is summed up along each source, and
inside a range rows are summed by a window of their own. As keys are random, ranges of one source are even.

Targets: weights repeat along the sources in code-point order, null last. A share of all words is dealt out by
weight; a source's target stops at `cap` times its size, and the excess goes to the others by weight. The
level at which this comes to rest is found by one sort of the sources by size over weight.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own; documents without
words take 0; repeated rows are separate documents that tie in order, and only rows of one id (or none) and one text share
a key, hence a task; an empty table gives no rows. Columns
that clash with the operator's own names do no harm: `carry` names what is kept besides the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
SEED = "mix-1"
#: Hex digits of the key that name a range: 16 ** 3 ranges in each source.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sums: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target, from one row for each source (source, source_size)."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sums.select("source", "source_size", weight.alias("w"))
    s = s.select("*", (F.lit(cap) * F.col("source_size")).alias("most"), (F.lit(share) * F.sum("source_size").over(every)).alias("budget"), F.sum("w").over(every).alias("all_w"))
    s = s.withColumn("bound", F.col("most") / F.col("w"))
    before = Window.orderBy("bound", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    spent, used = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("most", "w"))
    s = s.withColumn("level", (F.col("budget") - spent) / (F.col("all_w") - used))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("bound"), F.col("level"))).over(every))
    return s.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, by_text: bool = True) -> DataFrame:
    """id, size, source_size, target, taken, and source; `carry`'s columns follow as a struct `row`. The order is by a hash of
    id and text, or without `by_text` of the id, and of the text only where there is no id."""
    scratch = Scratch(docs.sparkSession, "mix")
    named, text = F.col(id_col).cast("string"), F.concat(F.lit(":"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    told = F.concat(F.coalesce(named, F.lit("")), text) if by_text else F.coalesce(named, text)
    key = F.md5(F.concat(F.lit(f"{seed}:"), told).cast("binary"))
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), *([F.struct(*carry).alias("row")] if carry else []))
    if not carry:
        base = scratch.put(base, "sizes")
    base = base.withColumn("range", F.substring("key", 1, DIGITS))
    sums = scratch.put(base.groupBy("source", "range").agg(F.sum("size").alias("size")), "sums")
    goal = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "range", F.coalesce(F.sum("size").over(along), F.lit(0)).alias("start"))
    starts = starts.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumnsRenamed({"source": "in_source", "range": "in_range"})
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("range") == F.col("in_range")))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rest = budget - passes * F.col("source_size") - F.col("start") - F.col("ahead")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars"), **options) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document, the one at the cut whole."""
    made = mix(docs, carry=columns, **options)
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).otherwise(F.lit(0)).cast("int")
    return made.select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


OP3_SQL = f"""
WITH base AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w FROM s),
b AS (SELECT *, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w FROM w),
l AS (SELECT *, most / w AS bound,
        (budget - coalesce(sum(most) OVER o, 0)) / (all_w - coalesce(sum(w) OVER o, 0)) AS level
      FROM b WINDOW o AS (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(most, (max(CASE WHEN level <= bound THEN level END) OVER ()) * w) AS target FROM l),
p AS (SELECT base.*, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS budget,
        coalesce(sum(size) OVER (PARTITION BY base.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM base JOIN g ON base.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST((CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * size
    + greatest(0, least(size, budget - (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * source_size - ahead)) AS BIGINT) AS taken
FROM p
"""
