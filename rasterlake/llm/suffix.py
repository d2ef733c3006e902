"""Removal of long repeated substrings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same document or
another. Matches never cross documents; all is judged on the input.

Blocks. A transform of the whole corpus would be one job of one task, so strings that could be equal are first
brought together, without loss. Every window of `length` bytes names an anchor: among its K-byte substrings
the one of least hash, the leftmost of equals. Equal windows have equal anchors. Consecutive windows with the
same anchor form a context. Anchors that occur once can have no repeated window; contexts of an anchor that
are all equal are repeated as a whole. Only anchors with different contexts go on, each different context
once, and the contexts of an anchor always lie in one block.

A block. Contexts are joined by a byte that no UTF-8 text holds, suffixes are sorted by prefix doubling to a
depth of at least `length`, and the Burrows-Wheeler transform is expanded breadth first: the interval of a
string w gives, by backward extension, the intervals of all cw. The right end of an interval new at level l
has a longest common prefix of l with what follows. Values arise in increasing order, and expansion stops at
`length`: suffix neighbours still without a value agree in at least `length` bytes. A window is repeated if
it has such a neighbour.

An anchor with more than MAX_CONTEXTS different contexts (a very common passage in ever new surroundings) would
make a block too large for a task; its windows are counted one by one by a 128-bit hash, spread over the
cluster, which gives the same answer.

Defined results: a null or empty text, or one shorter than `length`, loses nothing; repeated rows are
documents of their own, so a text that occurs twice goes in both, if it is long enough; rows are told by id and
a hash of the text, so rows of one id with different texts have spans of their own. An empty table gives no rows. Columns other than the id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, n_partitions, table

LENGTH, K = 200, 32
#: Window starts handled at once; bounds a worker's memory, changes no result.
SEGMENT = 1 << 19
BLOCK_BYTES, MAX_CONTEXTS = 1 << 20, 8000
_SEPARATOR = 0xFF


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA5A3564E27F8863B)
    return x ^ (x >> np.uint64(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _substring_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A hash of every substring of k bytes, k a power of two, by doubling."""
    h, have = _BYTE[text], 1
    while have < k:
        h = _mix(h[:-have] * np.uint64(0xC2B2AE3D27D4EB4F) + h[have:]) if have == 1 else h[:-have] * np.uint64(2 * have * 0x1000193 + 0x5851F42D4C957F2D) + h[have:]
        have *= 2
    return _mix(h)


def anchors(text: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash) of each context in a piece of joined documents; ends: where each
    document ends."""
    n = len(text) - length + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    h = _substring_hashes(text, k)
    mask = np.uint64((1 << 21) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    wide, have = length - k + 1, 1
    while 2 * have <= wide:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    key = np.minimum(key[: len(key) - (wide - have)], key[wide - have :])
    at = (key & mask).astype(np.int64)
    whole = np.zeros(n + 1, bool)
    start = 0
    for end in ends.tolist():
        whole[start : max(start, end - length + 1)] = True
        start = end
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (whole[1:n] != whole[: n - 1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    # two documents can meet without a window between them only if a document ends at a window's start
    keep = whole[first]
    return first[keep], count[keep], h[at[first[keep]]]


def _pieces(docs: list[tuple[tuple, bytes]], length: int) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, list[tuple[int, tuple, int]]]]:
    """Joins short documents, cuts long ones with an overlap, to pieces of about SEGMENT bytes: bytes, ends, and
    (start in the piece, row's name, offset in the document)."""
    held, ends, places, size = [], [], [], 0

    def out():
        joined = b"".join(held)
        return np.frombuffer(joined, np.uint8), joined, np.array(ends), places

    for doc, text in docs:
        for offset in range(0, max(1, len(text) - length + 1), SEGMENT):
            part = text[offset : offset + SEGMENT + length - 1]
            if len(part) < length:
                continue
            if size and size + len(part) > SEGMENT:
                yield out()
                held, ends, places, size = [], [], [], 0
            places.append((size, doc, offset))
            held.append(part)
            size += len(part)
            ends.append(size)
    if size:
        yield out()


def _contexts(docs: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            rows = list(zip(ids, [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()], strict=True))
            for text, raw, ends, places in _pieces(rows, length):
                first, count, h = anchors(text, ends, length, k)
                starts = np.array([p[0] for p in places])
                of = np.searchsorted(starts, first, "right") - 1
                doc, name = (pa.array([p[1][j] for p in places], pa.int64()).take(pa.array(of)) for j in (0, 1))
                at = first - starts[of] + np.array([p[2] for p in places])[of]
                view = memoryview(raw)
                named = [xxhash.xxh3_64_intdigest(view[a:z]) for a, z in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)]
                columns = [pa.array(h.view(np.int64)), pa.array(np.array(named, np.uint64).view(np.int64)), doc, name, pa.array(at), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "c", "doc", "t", "at", "wins"])

    return docs.select("doc", "t", "text").mapInArrow(run, "h long, c long, doc long, t long, at long, wins int")


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by at least `depth` first bytes."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j]
    have = 8
    while True:
        order = np.argsort(key)
        new = np.empty(n, bool)
        new[0] = False
        ranked = key[order]
        new[1:] = ranked[1:] != ranked[:-1]
        step = np.cumsum(new)
        rank = np.empty(n, np.uint64)
        rank[order] = step + 1
        if have >= depth or step[-1] == n - 1:
            return order
        key = rank << np.uint64(32)
        key[: n - have] |= rank[have:]
        have *= 2


def long_neighbours(text: np.ndarray, length: int) -> np.ndarray:
    """For each position, whether another one starts with the same `length` bytes; positions with a separator
    within `length` bytes may be told either way."""
    n = len(text)
    order = sorted_suffixes(text, length)
    before = text[order - 1]
    before[order == 0] = _SEPARATOR
    by_char = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)
    back[by_char] = np.arange(n)
    begin = np.zeros(257, np.int64)
    np.cumsum(np.bincount(before, minlength=256), out=begin[1:])
    chars = [c for c in np.flatnonzero(np.diff(begin)).tolist() if c != _SEPARATOR]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    left, right = np.array([0]), np.array([n - 1])
    for _ in range(length):
        size = right - left + 1
        wide = size > 256
        made = []
        if wide.any():
            for c in chars:
                own = by_char[begin[c] : begin[c + 1]]
                a, z = np.searchsorted(own, left[wide]), np.searchsorted(own, right[wide] + 1)
                some = z > a
                made.append((begin[c] + a[some], begin[c] + z[some] - 1))
        left, size = left[~wide], size[~wide]
        for k in range(0, len(left), 1 << 18):
            l, s = left[k : k + (1 << 18)], size[k : k + (1 << 18)]  # noqa: E741
            total = int(s.sum())
            name = np.repeat(np.arange(len(l)), s)
            at = np.arange(total) - np.repeat(np.cumsum(s) - s, s) + l[name]
            c = before[at]
            some = c != _SEPARATOR
            # sorted by interval, then by the image, which holds the character's order
            key = np.sort((name[some].astype(np.uint64) << np.uint64(32)) | back[at[some]].astype(np.uint64))
            image = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            # images of one interval and character are consecutive, of another character they lie in its own range
            cut = np.flatnonzero((key[1:] != key[:-1] + np.uint64(1)) | (before[by_char[image[1:]]] != before[by_char[image[:-1]]])) + 1 if len(key) else np.empty(0, np.int64)
            if len(key):
                made.append((image[np.append(0, cut)], image[np.append(cut, len(key)) - 1]))
        if not made:
            break
        left, right = (np.concatenate([m[j] for m in made]) for j in (0, 1))
        fresh = unset[right + 1]
        left, right = left[fresh], right[fresh]
        if not len(left):
            break
        unset[right + 1] = False
    found = np.zeros(n, bool)
    found[order] = unset[:-1] | unset[1:]
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of set flags."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


_RUNS = "h long, c long, runs array<struct<a:int,z:int>>"


def _runs_batch(rows: list[tuple[int, int, list]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
    made = [[{"a": a, "z": z} for a, z in r[2]] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(made, kind)], names=["h", "c", "runs"])


def _expanded(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of every context (h, c, body); all contexts of an h come one after the other."""

    def block(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        sep = bytes([_SEPARATOR])
        found = long_neighbours(np.frombuffer(sep.join(r[2] for r in rows) + sep, np.uint8), length)
        out, start = [], 0
        for h, c, body in rows:
            out.append((h, c, _runs(found[start : start + len(body) - length + 1])))
            start += len(body) + 1
        return _runs_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for h, c, body in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                if size >= BLOCK_BYTES and h != rows[-1][0]:
                    yield block(rows)
                    rows, size = [], 0
                rows.append((h, c, body))
                size += len(body)
        if rows:
            yield block(rows)

    spread = contexts.select("h", "c", "body").repartition(n_partitions(contexts.sparkSession), "h").sortWithinPartitions("h")
    return spread.mapInArrow(run, _RUNS)


def _counted(contexts: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """The same for contexts too many for a block: windows are counted one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for h, c, body in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                n = len(body) - length + 1
                view = memoryview(body)
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[j : j + length]) for j in range(n)), np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array([h] * n), pa.array([c] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["h", "c", "j", "w1", "w2"])

    windows = scratch.put(contexts.select("h", "c", "body").mapInArrow(run, "h long, c long, j int, w1 long, w2 long"), "windows")
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return windows.join(again, ["w1", "w2"]).groupBy("h", "c").agg(F.transform(F.array_sort(F.collect_list("j")), lambda j: F.struct(j.alias("a"), j.alias("z"))).alias("runs"))


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, k: int = K, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """(doc, t, start, end): byte spans that cover every repeated string, from documents (doc, text); t is a hash of
    the text, which tells rows of one doc apart."""
    docs = docs.select("doc", "text", F.xxhash64("text").alias("t"))
    found = scratch.put(_contexts(docs, length, k), "contexts")
    groups = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    groups = scratch.put(groups.select("h", (F.col("lo") < F.col("hi")).alias("mixed")), "groups")
    hits = scratch.put(found.join(groups, "h"), "hits")
    scratch.drop("contexts")
    equal = hits.where("not mixed").select("doc", "t", F.col("at").alias("start"), (F.col("at") + F.col("wins") + length - 1).alias("end"))

    mixed = hits.where("mixed")
    kinds = scratch.put(mixed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "t", "at", "wins")).alias("one")), "kinds")
    # a context found more than once is repeated throughout; it still takes part, for the others
    wanted = kinds.groupBy(F.col("one.doc").alias("of"), F.col("one.t").alias("of_t")).agg(F.collect_list(F.struct("h", "c", F.col("one.at").alias("at"), F.col("one.wins").alias("wins"))).alias("want"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, want in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bodies = [text[w["at"] : w["at"] + w["wins"] + length - 1] for w in want]
                keep = [j for j, w in enumerate(want) if len(bodies[j]) == w["wins"] + length - 1]
                columns = [pa.array([want[j][x] for j in keep], pa.int64()) for x in ("h", "c")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([bodies[j] for j in keep], pa.binary())], names=["h", "c", "body"])

    bodies = docs.join(wanted, F.col("doc").eqNullSafe(F.col("of")) & (F.col("t") == F.col("of_t"))).select("text", "want").mapInArrow(cut, "h long, c long, body binary")
    bodies = scratch.put(bodies, "bodies")
    crowded = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_contexts).select("h")
    crowded = scratch.put(crowded, "crowded")
    if crowded.isEmpty():
        runs = _expanded(bodies, length)
    else:
        runs = _expanded(bodies.join(crowded, "h", "left_anti"), length).unionByName(_counted(bodies.join(crowded, "h", "left_semi"), scratch, length))
    single = scratch.put(runs.where(F.size("runs") > 0), "runs").withColumnsRenamed({"h": "h2", "c": "c2"})
    many = kinds.where("n > 1").select("h", "c")
    said = mixed.join(single, (F.col("h") == F.col("h2")) & (F.col("c") == F.col("c2"))).select("doc", "t", "at", F.explode("runs").alias("r"))
    said = said.select("doc", "t", (F.col("at") + F.col("r.a")).alias("start"), (F.col("at") + F.col("r.z") + length).alias("end"))
    whole = mixed.join(many, ["h", "c"], "left_semi").select("doc", "t", F.col("at").alias("start"), (F.col("at") + F.col("wins") + length - 1).alias("end"))
    return equal.unionByName(said).unionByName(whole)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, output: str = "digest") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, then kept_sha256 ("digest"), or spans and the kept bytes ("text")."""
    scratch = Scratch(docs.sparkSession, "suffix")
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    spans = repeated_spans(slim, scratch, length).groupBy(F.col("doc").alias("of"), F.col("t").alias("of_t")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = slim.join(spans, F.col("doc").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("of_t")), "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, merged = text or b"", []
                for s, e in sorted((x["start"], x["end"]) for x in found or ()):
                    e = min(e, len(text))
                    if s >= e:
                        continue
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                edges = [0, *(x for m in merged for x in m), len(text)]
                kept = b"".join(text[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
                last = [hashlib.sha256(kept).hexdigest()] if output == "digest" else [merged, kept]
                rows.append((doc, len(text), len(text) - len(kept), len(merged), *last))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", *(["kept_sha256"] if output == "digest" else ["spans", "kept"])]
    kinds = [pa.int64()] * 4 + ([pa.string()] if output == "digest" else [pa.list_(pa.list_(pa.int64())), pa.binary()])
    return both.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if output == "digest" else "spans array<array<long>>, kept binary"))


def op1_suffix(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
