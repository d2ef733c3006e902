"""Object graphs and page operator streams: reachability, reference cleanup, placements."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, count

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import first_rows
from .stored import stored

#: Levels after which the reached set is written as one, so that plans stay short.
LEVELS = 16


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(key, depth) of every object reachable from `roots` (key) along `edges` (src, dst), cycles allowed.

    A frontier loop: each pass joins only the objects that the last one reached, until there are none. The
    reached set is written to the checkpoint folder once per level, so lineage stays short and no level is
    computed twice. If `max_depth` is given and objects lie deeper, ValueError is raised.
    """
    # laid out by source once, so that a level moves its frontier alone
    edges = stored(edges.select("src", "dst").repartition("src"))
    seen = roots.select("key", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in count(1):
        step = edges.join(frontier, F.col("src") == F.col("key"), "left_semi").select(F.col("dst").alias("key")).distinct()
        frontier = stored(step.join(seen, "key", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"objects lie deeper than {max_depth} levels")
        seen = seen.unionByName(frontier)
        if depth % LEVELS == 0:
            seen = stored(seen)
    return seen


def collect_garbage(objects: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The objects that no root reaches."""
    return objects.join(reachable(edges, roots, max_depth).select("key"), "key", "left_anti")


Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: What a part of a stream starts from: the matrix in force there. The k-th matrix saved below it is k from 1 on.
HERE = 0


def product(m: Matrix, base: Matrix) -> Matrix:
    """m applied before base."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = base
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


def extents(m: Matrix) -> tuple[float, float]:
    """Width and height of what is painted in a unit square."""
    return (m[0] * m[0] + m[1] * m[1]) ** 0.5, (m[2] * m[2] + m[3] * m[3]) ** 0.5


def summary(steps: Iterable[tuple[str, Matrix | None]]) -> tuple[int, tuple[Matrix, int], list[tuple[Matrix, int]]]:
    """What a part of an operator stream does, whatever comes before it: how many matrices saved earlier it takes, the
    matrix in force at its end, and those it leaves saved. A matrix is told as (m, k): m before the k-th start."""
    taken, now, saved = 0, (IDENTITY, HERE), []
    for op, m in steps:
        if op == "save":
            saved.append(now)
        elif op == "transform" and m is not None:
            now = product(m, now[0]), now[1]
        elif op == "restore":
            if saved:
                now = saved.pop()
            else:
                taken += 1
                now = IDENTITY, taken
    return taken, now, saved


def replay(steps: Iterable[tuple[str, Matrix | None]], now: Matrix = IDENTITY, saved: list[Matrix] | None = None) -> Iterator[Matrix]:
    """The matrix in force after each step, from a matrix and those saved (the last one on top); a restore without a
    save gives the identity. Linear in the steps."""
    saved = list(saved or [])
    for op, m in steps:
        if op == "save":
            saved.append(now)
        elif op == "transform" and m is not None:
            now = product(m, now)
        elif op == "restore":
            now = saved.pop() if saved else IDENTITY
        yield now


def _told(batches: Iterator[pa.RecordBatch], kind: pa.DataType, most: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """Of a task's rows (stream, seq, op, a to f, obj, part), sorted by stream and seq: a row for each paint, its matrix
    told from a start as in summary(), and one for the effect of the first and of the last stream, which may lie in other
    tasks too. `cut` marks the first stream, the only one that others may have begun. No stream is held, only its saved
    matrices."""
    kinds = [kind, pa.int32(), pa.bool_(), pa.int64(), pa.string(), *[pa.float64()] * 6, pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int32())]
    names = ["stream", "part", "cut", "seq", "obj", *"abcdef", "start", "taken", "values", "starts"]
    made: list[tuple] = []

    def batch() -> pa.RecordBatch:
        nonlocal made
        columns, made = zip(*made, strict=True), []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def effect() -> tuple:
        ends = [*saved, now]
        return stream, part, cut, None, None, *[None] * 7, taken, [x for m, _ in ends for x in m], [k for _, k in ends]

    begun, cut, stream, part, taken, now, saved = False, True, None, None, 0, (IDENTITY, HERE), []
    for some in batches:
        for of, seq, op, a, b, c, d, e, f, obj, at in zip(*(x.to_pylist() for x in some.columns), strict=True):
            if begun and of != stream:
                if cut:
                    made.append(effect())
                cut, taken, now, saved = False, 0, (IDENTITY, HERE), []
            begun, stream, part = True, of, at
            if op == "save":
                saved.append(now)
            elif op == "transform":
                now = product((a, b, c, d, e, f), now[0]), now[1]
            elif op == "restore":
                if saved:
                    now = saved.pop()
                else:
                    taken += 1
                    now = IDENTITY, taken
            elif op == "paint":
                made.append((stream, part, cut, seq, obj, *now[0], now[1], None, None, None))
                if len(made) >= most:
                    yield batch()
    if begun:
        made.append(effect())
        yield batch()


def _begun(parts: pd.DataFrame) -> pd.DataFrame:
    """Of the effects of one stream's parts, the starts of each but the first."""
    now, saved, made = IDENTITY, [], []
    for n, r in enumerate(parts.sort_values("part").itertuples(index=False)):
        top = saved[len(saved) - min(r.taken, len(saved)) :]
        of = [now, *reversed(top), *[IDENTITY] * (r.taken - len(top))]
        made += [(r.stream, r.part, k, *m) for k, m in enumerate(of)] if n else []
        told = [product(tuple(r.values[6 * k : 6 * k + 6]), of[start]) for k, start in enumerate(r.starts)]
        saved, now = saved[: len(saved) - len(top)] + told[:-1], told[-1]
    return pd.DataFrame(made, columns=["of", "in_part", "at", *"pqrstu"])


def replayed_rows(events: DataFrame, stream: str, span: int = 1 << 16) -> DataFrame:
    """(stream, seq, obj, width, height) of every paint in streams of operators that are rows: stream, seq (long), op
    (save, restore, transform, paint; any other does nothing), a to f, obj.

    Rows are dealt to tasks by ranges of (stream, seq), some `span` rows each, and every task replays its rows in one go,
    however many streams they are. Where a stream goes over several tasks, its parts' effects, which don't depend on what
    comes before, meet once to give every part its starts: at most two effects from a task."""
    kind = events.schema[stream].dataType.simpleString()
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    rows = events.select(F.col(stream).alias("stream"), F.col("seq").cast("long").alias("seq"), "op", *map(number, "abcdef"), F.col("obj").cast("string").alias("obj"))
    tasks = max(1, -(-rows.count() // span))
    dealt = rows.repartitionByRange(tasks, "stream", "seq").sortWithinPartitions("stream", "seq").withColumn("part", F.spark_partition_id())
    schema = f"stream {kind}, part int, cut boolean, seq long, obj string, {', '.join(f'{c} double' for c in 'abcdef')}, start int, taken int, values array<double>, starts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is not None:
            yield from _told(chain([head], batches), head.schema.field(0).type)

    # stored, so that all that follows sees the parts of one dealing
    told = stored(dealt.mapInArrow(run, schema))
    effects = told.where("taken is not null").select("stream", "part", "taken", "values", "starts")
    starts = effects.groupBy("stream").applyInPandas(_begun, f"of {kind}, in_part int, at int, {', '.join(f'{c} double' for c in 'pqrstu')}")
    paints = told.where("taken is null")
    met = paints.where("cut").join(starts, F.col("stream").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")) & (F.col("start") == F.col("at")), "left")
    m = tuple(F.col(c) for c in "abcdef")
    moved = product(m, tuple(F.coalesce(F.col(c), F.lit(x)) for c, x in zip("pqrstu", IDENTITY, strict=True)))
    size = lambda m: (F.sqrt(m[0] * m[0] + m[1] * m[1]).alias("width"), F.sqrt(m[2] * m[2] + m[3] * m[3]).alias("height"))
    made = paints.where("not cut").select("stream", "seq", "obj", *size(m)).unionByName(met.select("stream", "seq", "obj", *size(moved)))
    return made.withColumnRenamed("stream", stream)


def page_paints(pages: DataFrame) -> DataFrame:
    """(path, page, seq, obj, width, height) of every paint of pages (path, page, ops): a page is read by one task
    anyway."""
    schema = "path string, page string, seq int, obj string, width double, height double"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for path, page, ops in batch[["path", "page", "ops"]].itertuples(index=False):
                steps = [(o["op"], tuple(o["m"][k] for k in "abcdef") if o["m"] is not None else None) for o in ops]
                made += [(path, page, n, o["obj"], *extents(m)) for n, (o, m) in enumerate(zip(ops, replay(steps), strict=True)) if o["op"] == "paint"]
            yield pd.DataFrame(made, columns=names)

    return pages.select("path", "page", "ops").mapInPandas(run, schema)


def placements(paints: DataFrame, scope: str = "page") -> DataFrame:
    """(path, key, width, height) for each painted object, from (path, page, place, seq, obj, width, height), place being
    the page's among the file's: the largest on the first page that paints it, or (`scope` document) the largest of all;
    of equals the first painted. An object that is painted without extent has no placement."""
    if scope not in ("page", "document"):
        raise ValueError("a scope is page or document")
    area = (F.col("width") * F.col("height")).alias("area")
    first = F.struct("path", F.col("obj").alias("key"), "place", "seq", "width", "height", area).alias("x")
    rows = paints.where("obj is not null").select(first).select("x.*")
    size = F.struct("area", (-F.col("place")).alias("place"), (-F.col("seq")).alias("seq"))
    best = F.max_by(F.struct("width", "height"), size).alias("s")
    if scope == "page":
        # one row for each page and object, then the first page's
        rows = rows.groupBy("path", "key", "place").agg(best)
        rows = first_rows(rows, ["path", "key"], F.col("place"))
    else:
        rows = rows.groupBy("path", "key").agg(best)
    return rows.where("s.width > 0 and s.height > 0").select("path", "key", "s.width", "s.height")


def largest_placement(paints: DataFrame, keys: list[str], area: Column, seq: list[Column], value: Column) -> DataFrame:
    """The value with the largest area per key, the first of equals in `seq` order (descending keys, negated)."""
    return paints.groupBy(*keys).agg(F.max_by(value, F.struct(area.alias("area"), *seq)).alias("placed"))


def candidate_images(objects: DataFrame) -> DataFrame:
    """Raw image streams without masks, of 2048 bytes or more, from (kind, dict, content)."""
    d = F.col("dict")
    plain = (F.coalesce(d["ImageMask"], F.lit("")) != "true") & d["SMask"].isNull() & d["Mask"].isNull()
    return objects.where((F.col("kind") == "stream") & (d["Subtype"] == "/Image") & plain & (F.length("content") >= 2048))


def strip_metadata(objects: DataFrame) -> DataFrame:
    """Empties the information dictionary that the trailer names, drops the catalog's Metadata and pages' Thumb, with
    the references they held."""
    info = objects.where("kind = 'trailer'").select(F.col("path").alias("of"), F.explode("refs").alias("r")).where("r.entry = 'Info'").select("of", F.col("r.dst").alias("info"))
    rows = objects.join(info, F.col("path") == F.col("of"), "left").drop("of")
    d = F.col("dict")
    kept = lambda k: F.when(F.coalesce(F.col("key") == F.col("info"), F.lit(False)), F.lit(False)).when(F.coalesce(d["Type"] == "/Catalog", F.lit(False)), k != "Metadata").when(F.coalesce(d["Type"] == "/Page", F.lit(False)), k != "Thumb").otherwise(F.lit(True))
    return rows.withColumns({"dict": F.map_filter(d, lambda k, v: kept(k)), "refs": F.filter("refs", lambda r: kept(r["entry"]))}).drop("info")
