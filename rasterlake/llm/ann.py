"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is rotated by one random orthogonal matrix and kept as the signs of its rotated components,
packed into bits, plus correction scalars: its length and the inner product of its unit vector with its own
code's unit vector. From these the inner product with a rotated query is estimated without bias; the error
is, with high probability, within ERROR_BOUND standard deviations. A query's candidates are reranked on the
original vectors if their upper bound reaches a floor: the k-th best true value among the best estimates.

Queries and rows meet in cells: queries are dealt into groups of some GROUP_QUERIES, rows into STRIPES stripes, and a
cell is one group with one stripe. A cell's task holds its queries, reads its rows in batches, keeps the best `k` found
so far for each query, whose k-th is a floor for later batches, and gives these once at the end; a query's cells meet in
one window. So there are at most STRIPES * k rows a query, however many rows are searched. Nothing is collected, one row
for each vector length is broadcast, and no partner is dropped: what a cell leaves out has, by the bounds, k better rows in that cell.

Cost: every query meets every row once, in bits; with one vector length all groups of queries meet all rows, which is
the stated query set against all rows. A query travels STRIPES times, a row once for each group: at 10^9 vectors of 64
components and 1 in 20 asking, some 12,000 times. At that size queries should be fewer, or rows be parted first; nothing
here does that.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; a query is
compared with the vectors of its own length, as an inner product with others isn't defined. Equal scores go to the smaller id. A query's own id is no
candidate, but a copy of its vector under another id is. Rows that repeat an id are candidates each; a
repeated id asks once, with the smallest of its vectors. Empty tables give no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, one_thread, table

#: Standard deviations of the estimate's error that the bounds allow for.
ERROR_BOUND = 2.5
SEED = 20240607
#: Queries that a cell holds, some MB at 64 dimensions, and parts that the rows are dealt into.
GROUP_QUERIES, STRIPES = 4096, 8
#: Rows of a cell that are compared at once.
BLOCK_ROWS = 2048


@lru_cache(maxsize=16)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and the inner products of unit vectors with their codes."""
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    turned = (vectors / length[:, None]) @ turn
    own = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), length, own


def estimate(query: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries with coded vectors, and the half width of their bounds."""
    dim = query.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    scale = (length / (own * np.sqrt(dim))).astype(np.float32)
    guess = ((query @ turn).astype(np.float32) @ signs.T) * scale
    spread = length * np.sqrt(np.maximum(0.0, 1 - own**2)) / (own * np.sqrt(max(1, dim - 1)))
    return guess, np.sqrt(np.einsum("ij,ij->i", query, query))[:, None].astype(np.float32) * (ERROR_BOUND * spread).astype(np.float32)


def best(qid: np.ndarray, query: np.ndarray, vid: np.ndarray, vectors: np.ndarray, coded: tuple, k: int, turn: np.ndarray, under: np.ndarray, step: int = 128) -> Iterator[tuple[np.ndarray, ...]]:
    """The best k rows of one block for each query, of those that reach its floor `under`: query index, row index, score."""
    for a in range(0, len(qid), step):
        q = query[a : a + step]
        guess, wide = estimate(q, *coded, turn)
        same = vid[None, :] == qid[a : a + step, None]
        guess[same] = -np.inf
        # the k-th best of the true values of the best guesses is a floor that the k-th best can't be under
        some = min(3 * k, len(vid))
        front = np.argpartition(-guess, some - 1, axis=1)[:, :some] if some < len(vid) else np.tile(np.arange(len(vid)), (len(q), 1))
        true = np.einsum("ij,ikj->ik", q, vectors[front])
        true[np.take_along_axis(same, front, axis=1)] = -np.inf
        edge = np.sort(true, axis=1)[:, -k] if k <= some else np.full(len(q), -np.inf)
        edge = np.maximum(edge, under[a : a + step])
        # estimates are single precision: a little room below the floor
        floor = np.where(np.isfinite(edge), edge - 1e-5 * (1 + np.abs(edge)), -np.inf)
        row, col = np.nonzero((guess + wide >= floor[:, None]) & ~same)
        score = np.concatenate([np.einsum("ij,ij->i", q[row[i : i + 65536]], vectors[col[i : i + 65536]]) for i in range(0, max(1, len(row)), 65536)])
        row, col, score = first_k(row, col, score, vid[col], k)
        yield row + a, col, score


def first_k(row: np.ndarray, col: np.ndarray, score: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first k of each `row` by falling score, then rising `vid`, sorted so."""
    order = np.lexsort((vid, -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], score[keep]


class Cell:
    """One group of queries, and the best k rows found so far for each of them."""

    def __init__(self, qid: np.ndarray, query: np.ndarray, k: int):
        self.qid, self.query, self.k = qid, query, k
        self.row, self.vid, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, vid: np.ndarray, vectors: np.ndarray, coded: tuple) -> None:
        under, n = np.full(len(self.qid), -np.inf), np.bincount(self.row, minlength=len(self.qid))
        if len(self.row):
            last = np.searchsorted(self.row, np.flatnonzero(n == self.k), "right") - 1
            under[self.row[last]] = self.score[last]
        found = [(self.row, self.vid, self.score), *((i, vid[j], s) for i, j, s in best(self.qid, self.query, vid, vectors, coded, self.k, rotation(self.query.shape[1]), under))]
        row, vids, score = map(np.concatenate, zip(*found, strict=True))
        self.row, self.vid, self.score = first_k(row, vids, score, vids, self.k)

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.qid[self.row]), pa.array(self.vid), pa.array(self.score)], names=["query_id", "vec_id", "score"])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds codes, lengths and products with own codes to rows (id, v)."""
    for batch in batches:
        size = np.diff(batch.column("v").offsets.to_numpy())
        for dim in np.unique(size):
            some = batch.filter(pa.array(size == dim))
            v = _matrix(some, "v")
            codes, length, own = encode(v, rotation(int(dim)))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(own)], names=["id", "v", "codes", "length", "own"])


def _searched(k: int):
    """Of a task's cells one after the other, each its queries, then its rows: the best k rows of each query in the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, cell = None, [], None
        for batch in batches:
            key, is_row = batch.column("cell").to_numpy(), batch.column("is_row").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(key) != 0) | (is_row[1:] != is_row[:-1])) + 1
            for a, z in zip([0, *edges], [*edges, len(key)], strict=True):
                part = batch.slice(a, z - a)
                if key[a] != at:
                    if cell is not None:
                        yield cell.rows()
                    at, asked, cell = key[a], [], None
                if not is_row[a]:
                    asked.append((part.column("id").to_numpy(), _matrix(part, "v")))
                    continue
                if cell is None:
                    if not asked:
                        continue
                    cell, asked = Cell(*map(np.concatenate, zip(*asked, strict=True)), k), []
                for i in range(0, len(part), BLOCK_ROWS):
                    some = part.slice(i, BLOCK_ROWS)
                    codes = np.frombuffer(b"".join(some.column("codes").to_pylist()), np.uint8).reshape(len(some), -1)
                    cell.meet(some.column("id").to_numpy(), _matrix(some, "v"), (codes, some.column("length").to_numpy(), some.column("own").to_numpy()))
        if cell is not None:
            yield cell.rows()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of `vectors` with the largest inner product found for
    each row of `queries`, in double precision."""
    scratch = Scratch(vectors.sparkSession, "ann")
    one_thread(vectors.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fine)

    asked = scratch.put(usable(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    coded = scratch.put(usable(vectors).mapInArrow(_coded, "id long, v array<double>, codes binary, length double, own double"), "rows")
    # one row for each vector length asked for: how many groups its queries make, and its first cell
    sizes = asked.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).alias("groups"))
    sizes = sizes.withColumn("first", F.coalesce(F.sum("groups").over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = scratch.put(sizes, "cells")
    n = cells.agg(F.sum("groups")).first()[0] or 1
    group = F.col("first") + F.pmod(F.xxhash64("id"), F.col("groups"))
    sent = asked.join(F.broadcast(cells), F.size("v") == F.col("dim")).select(group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(STRIPES - 1))).alias("stripe"), F.lit(False).alias("is_row"), "id", "v", *(F.lit(None).cast(t).alias(c) for c, t in (("codes", "binary"), ("length", "double"), ("own", "double"))))
    stripe = F.pmod(F.xxhash64("id", "v"), F.lit(STRIPES)).cast("int")
    every = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("groups") - 1))
    read = coded.join(F.broadcast(cells), F.size("v") == F.col("dim")).select(every.alias("group"), stripe.alias("stripe"), F.lit(True).alias("is_row"), "id", "v", "codes", "length", "own")
    # one cell a task, up to a number of tasks; inside it queries come before rows
    cell = (F.col("group") * STRIPES + F.col("stripe")).cast("int")
    both = sent.unionByName(read).withColumn("cell", cell).drop("group", "stripe")
    tasks = int(min(n * STRIPES, 20_000))
    met = both.repartitionById(tasks, F.pmod("cell", F.lit(tasks))).sortWithinPartitions("cell", "is_row")
    met = met.mapInArrow(_searched(k), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
