"""Exact k-means on integer vectors with Elkan's bounds.

Vectors become integers, floor(1024 x). Every vector keeps an upper bound of the distance to its own centroid and a
lower bound of the distance to each of the k centroids. A round shifts the bounds by how far centroids moved, skips
what they settle (own bound below half the distance to the nearest other centroid, or below a centroid's lower bound
or half its distance from the own one), and calculates the rest.

Bounds are rounded outward at every step and prune only where they are strictly apart, so that a centroid which could
be as near as the own one is always compared; comparisons themselves are of exact integer squared distances, ties
going to the smaller number. Results are thus those of the plain method.

A round is one pass of Arrow tasks over a table of vectors with their bounds; it writes that table anew, and with it
each task's sums of every centroid's vectors. From these k centroids (k small) are made with exact division on the
driver, which sends them out with the next pass. Nothing else is collected, and the table is written, not cached, so a
lost executor costs its own tasks only.

Defined results: vectors that are null, have another length, or hold null or non-finite components take no part, nor
do such whose components are not finite once scaled. Each row is a vector, also if it repeats an id or has none; rows
without an id start no centroid unless too few have one. With fewer vectors than centroids all start one; an empty
table gives no rows. Of equal hashes the smaller vector comes first. Components of any finite size are held exactly;
where a distance or a sum exceeds the largest long, that is what is returned. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, one_thread, table

SCALE, MAX_LONG = 1024, 2**63 - 1
#: Components below this have squared distances, and products, that doubles hold exactly at up to 64 components.
NARROW = 1 << 22
#: Sums of larger ones travel in parts of so many bits.
LIMB = 48
_UP, _DOWN = 1 + 2.0**-50, 1 - 2.0**-50


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All squared distances, exact, of narrow vectors and centroids (doubles that hold integers)."""
    whole = lambda v: v.astype(np.int64)
    return whole(np.einsum("ij,ij->i", x, x))[:, None] + whole(np.einsum("ij,ij->i", centroids, centroids)) - 2 * whole(x @ centroids.T)


def own_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x to the same row of c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d).astype(np.int64)


def wide_squares(x: np.ndarray, centroids: list[list[int]]) -> list[list[int]]:
    """The same in integers of any size."""
    return [[sum((int(p) - q) ** 2 for p, q in zip(row, c, strict=True)) for c in centroids] for row in x.tolist()]


class Round:
    """One assignment: centroids, how far each moved at most, half their distances at least."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None):
        self.exact = centroids
        self.narrow = max((abs(v) for c in centroids for v in c), default=0) < NARROW
        self.calculated = 0
        if not self.narrow:
            return
        self.c = np.array(centroids, np.float64)
        half = np.sqrt(squares(self.c, self.c).astype(np.float64)) / 2 * _DOWN
        np.fill_diagonal(half, np.inf)
        self.half, self.nearest_half = half, half.min(axis=1)
        if before is None or max(abs(v) for c in before for v in c) >= NARROW:
            self.moved = None
        else:
            self.moved = np.sqrt(own_squares(self.c, np.array(before, np.float64)).astype(np.float64)) * _UP

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Changes the rows' centroids a and their bounds to those of this round. A row that was never assigned has
        a negative centroid."""
        wide = np.abs(x).max(axis=1) >= NARROW if self.narrow else np.ones(len(x), bool)
        fresh = ~wide & ((a < 0) | np.isinf(upper)) if self.narrow and self.moved is not None else ~wide
        if wide.any():
            rows = np.flatnonzero(wide)
            a[rows] = [min(range(len(d)), key=d.__getitem__) for d in wide_squares(x[rows], self.exact)]
            upper[rows], lower[rows] = np.inf, 0.0
            self.calculated += len(rows) * len(self.exact)
        if fresh.any():
            rows = np.flatnonzero(fresh)
            d = squares(x[rows], self.c)
            a[rows] = d.argmin(axis=1)
            root = np.sqrt(d.astype(np.float64))
            lower[rows], upper[rows] = root * _DOWN, root.min(axis=1) * _UP
            self.calculated += d.size
        rows = np.flatnonzero(~wide & ~fresh)
        if len(rows):
            self._bounded(rows, x, a, upper, lower)

    def _bounded(self, rows: np.ndarray, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        upper[rows] = (upper[rows] + self.moved[a[rows]]) * _UP
        lower[rows] = np.maximum(0.0, (lower[rows] - self.moved) * _DOWN)
        rows = rows[~(upper[rows] < self.nearest_half[a[rows]])]
        open_ = self._open(rows, a, upper, lower)
        rows = rows[open_.any(axis=1)]
        if not len(rows):
            return
        # the own distance first: it closes most of what the shifted bound left open
        own = own_squares(x[rows], self.c[a[rows]])
        self.calculated += len(rows)
        self._hold(rows, a[rows], own, upper, lower)
        for j in range(len(self.c)):
            at = np.flatnonzero(self._open(rows, a, upper, lower, j))
            if not len(at):
                continue
            some = rows[at]
            d = own_squares(x[some], self.c[j])
            self.calculated += len(some)
            lower[some, j] = np.sqrt(d.astype(np.float64)) * _DOWN
            better = (d < own[at]) | ((d == own[at]) & (j < a[some]))
            at, some, d = at[better], some[better], d[better]
            a[some], own[at] = j, d
            self._hold(some, np.full(len(some), j), d, upper, lower)

    def _hold(self, rows, own, d, upper, lower) -> None:
        root = np.sqrt(d.astype(np.float64))
        upper[rows] = root * _UP
        lower[rows, own] = root * _DOWN

    def _open(self, rows, a, upper, lower, j=slice(None)) -> np.ndarray:
        """Whether centroid j (or each) may be as near as the own one. The own one is closed: half its distance from
        itself counts as infinite."""
        u = upper[rows] if not isinstance(j, slice) else upper[rows, None]
        return ~((u < lower[rows, j]) | (u < self.half[a[rows], j]))

    def distances(self, x: np.ndarray, a: np.ndarray) -> list[int]:
        """Exact squared distance of each row to its centroid."""
        if self.narrow and (not len(x) or np.abs(x).max() < NARROW):
            return own_squares(x, self.c[a]).tolist()
        return [wide_squares(row[None], [self.exact[j]])[0][0] for row, j in zip(x, a.tolist(), strict=True)]


def sums(x: np.ndarray, a: np.ndarray, k: int) -> list[list[int]]:
    """Exact sums of each centroid's rows."""
    if len(x) < 1 << 30 and (not len(x) or np.abs(x).max() < NARROW):
        own = np.zeros((k, len(x)))
        own[a, np.arange(len(x))] = 1
        return (own @ x).astype(np.int64).tolist()
    out = [[0] * x.shape[1] for _ in range(k)]
    for row, j in zip(x.tolist(), a.tolist(), strict=True):
        out[j] = [s + int(v) for s, v in zip(out[j], row, strict=True)]
    return out


def limbs(values: list[int]) -> list[list[int]]:
    """The values in parts of LIMB bits, lowest first, each part signed; as many parts as the largest asks for."""
    out = []
    while True:
        low = [v - ((v >> LIMB) << LIMB) for v in values]
        values = [v >> LIMB for v in values]
        if all(v in (0, -1) for v in values):
            out.append([p + (v << LIMB) for p, v in zip(low, values, strict=True)])
            return out
        out.append(low)


def integers(vectors: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """id and x, the kept vectors as integers (held in doubles, which is exact)."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double") * SCALE)
    fine = F.coalesce((F.size(vector_col) == dim) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    made = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.col(vector_col)).where(fine)
    # Spark's floor gives a long, which large values exceed; these are integers as they are
    return made.select("id", F.transform("x", lambda v: F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)).alias("x"))


_STATE = "id long, x array<double>, cluster int, upper double, lower array<double>, distance long, limb int, n long, total array<long>, calculated long"


def _pass(state: DataFrame, dim: int, centroids: list[list[int]], before: list[list[int]] | None, last: bool) -> DataFrame:
    """The state after one assignment, and rows (limb not null) with each task's sums, or at last the distances."""
    k = len(centroids)
    names = [f.split()[0] for f in _STATE.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()]

    def record(size: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(size, t)) for c, t in zip(names, kinds, strict=True)], names=names)

    def lists(m: np.ndarray, width: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * width), pa.array(m.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        this, totals, counts = Round(centroids, before), [[0] * dim for _ in range(k)], np.zeros(k, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            if before is None:
                a, upper, lower = np.full(n, -1, np.int32), np.full(n, np.inf), np.zeros((n, k))
            else:
                a, upper = (np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in (2, 3))
                lower = np.array(batch.column(4).flatten().to_numpy(zero_copy_only=False)).reshape(n, k)
            this.assign(x, a, upper, lower)
            if last:
                far = [min(MAX_LONG, d) for d in this.distances(x, a)]
                yield record(n, id=batch.column(0), cluster=pa.array(a, pa.int32()), distance=pa.array(far, pa.int64()))
                continue
            totals = [[p + q for p, q in zip(s, t, strict=True)] for s, t in zip(totals, sums(x, a, k), strict=True)]
            counts += np.bincount(a, minlength=k)
            yield record(n, id=batch.column(0), x=batch.column(1), cluster=pa.array(a, pa.int32()), upper=pa.array(upper), lower=lists(lower, k))
        if not last:
            rows = [(j, i, part, int(counts[j]) if not i else 0) for j in range(k) for i, part in enumerate(limbs(totals[j])) if counts[j]]
            work = [this.calculated if not m else 0 for m in range(len(rows))]
            yield record(len(rows), cluster=pa.array([r[0] for r in rows], pa.int32()), limb=pa.array([r[1] for r in rows], pa.int32()), n=pa.array([r[3] for r in rows], pa.int64()), total=pa.array([r[2] for r in rows], pa.list_(pa.int64())), calculated=pa.array(work, pa.int64()))

    return state.mapInArrow(run, _STATE)


def _moved(state: DataFrame, centroids: list[list[int]], dim: int) -> tuple[list[list[int]], int]:
    """The next centroids, from the tasks' sums: k by dim numbers, added up by Spark; and how often distances were
    calculated."""
    parts = state.where("limb is not null").select("cluster", "limb", "n", "calculated", F.posexplode("total").alias("at", "v"))
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    once = lambda c: F.sum(F.when(F.col("at") == 0, F.col(c)).otherwise(0))
    got = parts.groupBy("cluster", "limb", "at").agg(whole("v").alias("v"), once("n").alias("n"), once("calculated").alias("calculated")).collect()
    total, count = [[0] * dim for _ in centroids], [0] * len(centroids)
    for r in got:
        total[r["cluster"]][r["at"]] += int(r["v"]) << (LIMB * r["limb"])
        count[r["cluster"]] += r["n"]
    return [[t // n for t in s] if n else c for s, n, c in zip(total, count, centroids, strict=True)], sum(r["calculated"] for r in got)


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding", log: list[int] | None = None) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of every kept vector, the final centroids). log takes, for each round, how many
    distances were calculated."""
    spark = vectors.sparkSession
    one_thread(spark)
    scratch = Scratch(spark, "kmeans")
    start = integers(vectors, dim, id_col, vector_col)
    name = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = start.withColumn("name", name).orderBy(F.col("name").asc_nulls_last(), "x").limit(k).collect()
    centroids = [[int(v) for v in r["x"]] for r in first]
    nothing = [F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split()[0]) for f in _STATE.split(", ")[2:]]
    state, before = start.select("id", "x", *nothing), None
    if not centroids:
        return state.select("id", "cluster", "distance"), []
    for turn in range(rounds):
        state = scratch.put(_pass(state.where("limb is null"), dim, centroids, before, False), f"round-{turn}")
        scratch.drop(f"round-{turn - 1}")
        before, (centroids, work) = centroids, _moved(state, centroids, dim)
        if log is not None:
            log.append(work)
    made = _pass(state.where("limb is null"), dim, centroids, before, True).select("id", "cluster", "distance")
    made = scratch.put(made, "assigned")
    scratch.drop(f"round-{rounds - 1}")
    return made, centroids


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    made, centroids = cluster(vectors, **options)
    sums_ = {r["cluster"]: int(r["s"]) for r in made.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()} if centroids else {}
    own = F.array(*(F.lit(min(MAX_LONG, sums_.get(j, 0))).cast("long") for j in range(len(centroids)))) if centroids else F.array(F.lit(0).cast("long"))
    names = F.array(*(F.lit(digest(c)) for c in centroids)) if centroids else F.array(F.lit(""))
    of = lambda values: F.get(values, F.col("cluster"))
    return made.select(F.col("id").alias("vec_id"), "cluster", "distance", of(own).alias("cluster_inertia"), F.lit(min(MAX_LONG, sum(sums_.values()))).cast("long").alias("inertia"), of(names).alias("centroid_sha256"))


def op11_kmeans(spark, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round as a step of its own: all distances, then exact floors of the means."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    nearest = f"SELECT v.vec_id, v.x, arg_min(c.j, [CAST({square} AS BIGINT), c.j]) AS j, min(CAST({square} AS BIGINT)) AS d FROM kept v, {{}} c GROUP BY v.row, v.vec_id, v.x"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM kept ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(f'c{r}')})")
        steps.append(f"""m{r} AS MATERIALIZED (SELECT j, list(m ORDER BY i) AS x FROM (SELECT j, i, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
    FROM (SELECT j, unnest(range(1, 65)) AS i, unnest(x) AS e FROM a{r}) GROUP BY j, i) GROUP BY j)""")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.j = c.j)")
    steps.append(f"a{rounds} AS MATERIALIZED ({nearest.format(f'c{rounds}')})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
    CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j
"""


OP11_SQL = _op11_sql()
