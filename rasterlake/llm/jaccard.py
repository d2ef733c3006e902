"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles. All shingles have one global order, rarest first by an
estimate, then by hash. A set of n shingles may lack d of them in a partner, so the first d + l shingles of two
similar sets have at least l in common, l being what the smaller of the two asks for.

Prefixes are lengthened where candidates would be dear. At first every set shows d + d/4 + 1 shingles; one that
finds no more than d/4 of them anywhere else has no partner and leaves before any pair is formed. The others,
whose buckets would cost pairs, show 2 d + l, l chosen for each set by estimated candidate cost, and must find
more than d of them; this is done again until few leave. A pair is verified only if it shares as many prefix
shingles as its sizes and the smaller l of the two ask for.

The frequency estimate is the product of word frequencies, counted over all documents in a table of fixed size
(words share its cells by hash), so it is small at any size of the corpus and needs no count of shingles.

Equal sets meet first, by a 128-bit hash, and enter the join as one node. Nodes that share one of their first
d + 1 shingles form a bucket. First every bucket's nodes are compared with one centre, the node that has fewest
shingles of its own before the bucket's; components then tell what is together already. What is open after that
is compared in full: nodes of different components, in small buckets pair by pair; nodes of large ones are dealt
to chunks by size, and those of two chunks that, by sizes and places in a bucket they have in common, could have a
partner in the other are compared node by node, where only nodes of components not
joined so far meet and only links that join two components leave the task. No pair that could link is left out. Pairs and chunks are held to a
bound first, from bitmaps of the parity of their shingles: cells that differ count shingles that only one of the two
has; then to the bound of finer bitmaps. What is left is verified on the whole sets of 64-bit shingle hashes, with
integer arithmetic.

Defined results: a null or empty text, or one of white space, has an empty set and is linked with nothing; a
text of fewer words than a shingle is one shingle; every row is returned. Rows that repeat an id are one
document with several sets: each set has its own links, and each row the least id reachable from its own set. A
row without an id has the least id of its component, null if there is none. An empty table gives no rows. Columns
other than the id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, one_thread, table
from .graph import components

CELLS = 1 << 17
#: Nodes of a bucket up to which open pairs are listed; bytes of a chunk's bitmaps in larger ones, and its nodes. Whole
#: sets are 10 to 40 times as large as bitmaps, and at most two chunks' are together in a task.
SMALL, CHUNK_BYTES, CHUNK_NODES = 8, 1 << 20, 1 << 14
#: Cells of a fine bitmap for each of a plain one: few of a pair's differing shingles then share a cell, and what its
#: bound leaves is hardly more than the links; it has a quarter of a set's bytes or less.
FINE = 8
MAX_L = 4
PRUNINGS = 2
#: Cost of verifying a pair, for each 100 shingles, against that of a shared prefix shingle.
VERIFY_COST = 4.0
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """word -> 64-bit hash; starts anew at a bounded size."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        at = self[word] = self.hash(word)
        return at

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order, of the whole sequence if it is shorter."""
    k = min(k, len(words))
    if k == 0:
        return words
    made = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        made = _mix(made + words[j : len(words) - k + 1 + j]) * _M
    return made + np.uint64(k)


def _halves(kept: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit name."""
    import xxhash

    both = np.frombuffer(xxhash.xxh3_128_digest(kept.tobytes()), np.int64)
    return int(both[0]), int(both[1])


def shingle_set(text: bytes | None, k: int, words: Words) -> np.ndarray:
    return np.unique(shingles(words.of(text), k))


def _word_cells(docs: DataFrame, text_col: str) -> np.ndarray:
    """Log share of each cell of the word table; its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                np.add.at(counts, (words.of(text) & np.uint64(CELLS - 1)).astype(np.int64), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["cell", "n"])

    got = docs.select(text_col).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full(CELLS, 0.5)
    counts[got["cell"].to_numpy(np.int64)] = got["n"]
    return np.append(np.log(counts / counts.sum()), np.log(max(1.0, counts.sum()))).astype(np.float32)


def pick(frequency: np.ndarray, base: int, n: int) -> int:
    """The l of least estimated cost, from the estimated frequencies of a set's shingles in order."""
    best, at = np.inf, 1
    met = np.cumsum(frequency[: base + MAX_L - 1])
    for level in range(1, MAX_L + 1):
        if base + level - 1 > n:
            break
        shared = met[base + level - 2]
        cost = base + level + shared + VERIFY_COST * (1 + n / 100) * shared / level**3
        if cost < best:
            best, at = cost, level
    return at


_SETS = "doc_id long, n long, s1 long, s2 long, l int, base int, toks array<long>"


def _sets(docs: DataFrame, k: int, percent: int, cells: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, share, total = Words(), cells[:-1], float(cells[-1])
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                hashes = words.of(text)
                every = shingles(hashes, k)
                kept, first = np.unique(every, return_index=True)
                n = len(kept)
                if not n:
                    rows.append((doc, 0, None, None, 0, 0, []))
                    continue
                log = share[(hashes & np.uint64(CELLS - 1)).astype(np.int64)]
                wide = min(k, len(hashes))
                guess = sum(log[j : len(log) - wide + 1 + j] for j in range(wide))[first] + total
                order = np.lexsort((kept, np.floor(guess * 2)))
                least = -(-percent * n // 100)
                base = min(n, 2 * (n - least) + 1)
                level = pick(np.exp(np.minimum(guess[order[: base + MAX_L]], 30.0)), base, n)
                rows.append((doc, n, *_halves(kept), level, base, kept[order[: base + level - 1]].view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=[f.split()[0] for f in _SETS.split(", ")])

    return docs.mapInArrow(run, _SETS)


def _signature(kept: np.ndarray, percent: int, fine: int = 1) -> bytes:
    """The parity of a set's shingles in each of so many cells by hash, in bits; a power of two, by the set's size."""
    bits = 1 << max(6, (16 * fine * (100 - percent) * len(kept) // 100).bit_length())
    return np.packbits(np.bincount((kept & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _differing(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of two sets alone: cells of unlike parity. The wider signature is folded."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _linked(pairs: DataFrame, full: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Signatures travel first, then fine ones, and whole sets for what these leave."""

    def joined(pairs: DataFrame, *columns: str) -> DataFrame:
        for c in "ab":
            pairs = pairs.join(full.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns)), c)
        return pairs.select("a", "b", *(f"{x}_{c}" for x in columns for c in "ab"))

    def filtered(keeps):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = batch.filter(pa.array([keeps(*(v.as_buffer() if isinstance(v, pa.BinaryScalar) else v.as_py() for v in row)) for row in zip(*batch.columns[2:], strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

        return run

    def close(n: int, n2: int, x: bytes, y: bytes) -> bool:
        return _differing(x, y) <= n + n2 + 2 * (-percent * (n + n2) // (100 + percent))

    def similar(x: bytes, y: bytes) -> bool:
        x, y = sorted((np.frombuffer(v, np.uint64) for v in (x, y)), key=len)
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        same = int(np.count_nonzero(y[at] == x))
        return 100 * same >= percent * (len(x) + len(y) - same)

    near = scratch.put(joined(pairs, "n", "sig").mapInArrow(filtered(close), "a long, b long"), f"{name}-near")
    near = scratch.put(joined(near, "n", "fine").mapInArrow(filtered(close), "a long, b long"), f"{name}-fine")
    return joined(near, "set").mapInArrow(filtered(similar), "a long, b long")


class Chunk:
    """Nodes of one side: names, parts, set sizes, and their signatures by width, as rows of words."""

    def __init__(self, node: np.ndarray, part: np.ndarray, n: np.ndarray, sigs: list[bytes] | pa.Array):
        self.node, self.part, self.n = node, part, n
        if isinstance(sigs, list):
            sigs = pa.array(sigs, pa.binary())
        ends = np.frombuffer(sigs.buffers()[1], np.int32)[sigs.offset : sigs.offset + len(sigs) + 1].astype(np.int64)
        data, wide = np.frombuffer(sigs.buffers()[2] or b"", np.uint8), np.diff(ends)
        self.rows = {int(w): np.flatnonzero(wide == w) for w in np.unique(wide)}
        self.words = {w: np.stack([data[ends[r] : ends[r] + w] for r in rows]).view(np.uint64) for w, rows in self.rows.items()}

    def folded(self, wide: int, to: int) -> np.ndarray:
        words = self.words[wide]
        return words if wide == to else np.bitwise_xor.reduce(words.reshape(len(words), -1, to // 8), axis=1)


def _near_rows(x: Chunk, y: Chunk, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of x: the rows of y whose sizes and signatures leave a link possible. Memory is that of one row's.

    Sizes are told first: a long set's signature is folded to a short one's few bits, where no difference shows."""
    for wide in x.words:
        sides = [(x.folded(wide, min(wide, w)), y.folded(w, min(wide, w)), y.rows[w]) for w in y.words]
        for k, i in enumerate(x.rows[wide]):
            found = []
            for mine, theirs, rows in sides:
                fits = np.flatnonzero(100 * np.minimum(y.n[rows], x.n[i]) >= percent * np.maximum(y.n[rows], x.n[i]))
                rows = rows[fits]
                differing = np.bitwise_count(theirs[fits] ^ mine[k]).sum(axis=1, dtype=np.int64)
                both = y.n[rows] + x.n[i]
                found.append(rows[differing <= both + 2 * (-percent * both // (100 + percent))])
            yield int(i), np.concatenate(found)


def _close(x: Chunk, y: Chunk, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes of each side could, by their signatures, be linked with one of the other's, of another part."""
    some = np.zeros(len(x.node), bool), np.zeros(len(y.node), bool)
    for i, near in _near_rows(x, y, percent):
        near = near[y.part[near] != x.part[i]]
        some[0][i] = len(near) > 0
        some[1][near] = True
    return some


def _edges(a: tuple, b: tuple, percent: int) -> list[tuple[int, int]]:
    """Links between two chunks (nodes, parts, sets) that join parts not joined so far, at most one for each part.

    Parts are joined as links are found, and what is joined isn't compared again, so that a group of near copies costs
    about a comparison a node; no matrix of nodes by nodes is made."""
    sides = [Chunk(np.asarray(c[0], np.int64), np.asarray(c[1], np.int64), np.array([len(s) for s in c[2]], np.int64), [_signature(s, percent) for s in c[2]]) for c in (a, b)]
    x, y = sides
    _, codes = np.unique(np.concatenate([*a[2], *b[2]]), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(np.concatenate([x.n, y.n]))])
    starts, here = ends[len(x.node) : -1], np.zeros(int(codes.max(initial=-1)) + 1, bool)
    _, parts = np.unique(np.concatenate([x.part, y.part]), return_inverse=True)
    group, mine, theirs = np.arange(int(parts.max(initial=-1)) + 1), parts[: len(x.node)], parts[len(x.node) :]
    found = []
    for i, near in _near_rows(x, y, percent):
        near = near[group[theirs[near]] != group[mine[i]]]
        if not len(near):
            continue
        own = codes[ends[i] : ends[i + 1]]
        here[own] = True
        step = 32
        while len(near):
            some, near = near[:step], near[step:]
            size = y.n[some]
            at = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            same = np.add.reduceat(here[codes[at]].astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
            linked = some[100 * same >= percent * (len(own) + size - same)]
            labels, first = np.unique(group[theirs[linked]], return_index=True)
            fresh = labels != group[mine[i]]
            found += [(int(x.node[i]), int(y.node[j])) for j in linked[first[fresh]]]
            if fresh.any():
                group[np.isin(group, labels)] = group[mine[i]]
                near = near[group[theirs[near]] != group[mine[i]]]
            step *= 2
        here[own] = False
    return found


def _in_chunks(members: DataFrame, full: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b) between different parts of each bucket, from members (tok, node, part, n, most). A node is in one chunk,
    by its size and the least node two buckets away, so that nodes of many buckets in common lie together. It goes to
    another chunk's nodes only for a bucket where, by their sizes and places, one of them could be its partner."""
    low = members.groupBy("tok").agg(F.min("node").alias("low"))
    # sizes of one band are similar, and those of bands that aren't neighbours never
    band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent))) if percent < 100 else F.col("n")
    named = members.join(low, "tok").groupBy("node", "n").agg(F.min("low").alias("label")).withColumn("band", band)
    many = named.groupBy("label", "band").agg(F.ceil(F.sum(F.greatest(F.lit(CHUNK_BYTES / CHUNK_NODES), F.col("n") * (4 * (100 - percent)) / 100)) / CHUNK_BYTES).alias("k"))
    dealt = named.join(many, ["label", "band"]).select("node", F.xxhash64("label", "band", F.pmod(F.xxhash64("node"), F.col("k"))).alias("own"))
    at = scratch.put(members.join(dealt, "node").select("tok", "own", "node", "part", "n", "most"), "dealt")
    there = at.groupBy("tok", F.col("own").alias("other")).agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("most").alias("furthest"), F.min("part").alias("low"), F.max("part").alias("high"))
    able = (F.col("n") <= F.col("furthest")) & (F.col("least_n") <= F.col("most")) & (100 * F.col("n") >= percent * F.col("least_n")) & (100 * F.col("most_n") >= percent * F.col("n"))
    sent = at.join(there, "tok").where(able & ((F.col("low") != F.col("part")) | (F.col("high") != F.col("part"))))
    sent = sent.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "part").distinct()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                i, j = batch.column(0)[one].as_py(), batch.column(1)[one].as_py()
                rows = batch.column(2)[one].values
                side, node, part, n = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                # a chunk that is compared with itself is one side
                chunks = [Chunk(node[at], part[at], n[at], rows.field(4).take(pa.array(at))) for at in (np.flatnonzero(side == k) for k in range(1 if i == j else 2))]
                if not all(len(c.node) for c in chunks):
                    continue
                use = _close(chunks[0], chunks[-1], percent)
                use = [use[0] | use[1]] if i == j else use
                kept = [np.concatenate([getattr(c, f)[u] for c, u in zip(chunks, use, strict=True)]) for f in ("node", "part")]
                sides = np.repeat(np.arange(len(use), dtype=np.int32), [int(u.sum()) for u in use])
                pair = [pa.array(np.full(len(sides), v), pa.int64()) for v in (i, j)]
                yield pa.RecordBatch.from_arrays([*pair, pa.array(sides), *map(pa.array, kept)], names=["i", "j", "side", "node", "part"])

    some = sent
    for column, name in (("sig", "close"), ("fine", "closer")):
        both = some.join(full.select("node", "n", column), "node").groupBy("i", "j").agg(F.collect_list(F.struct("side", "node", "part", "n", column)).alias("m"))
        some = scratch.put(both.mapInArrow(bounded, "i long, j long, side int, node long, part long"), name)
    sides = some.join(full.select("node", "set"), "node").groupBy("i", "j").agg(F.collect_list(F.struct("side", "node", "part", "set")).alias("m")).select("m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0):
                rows = one.values
                side, node, part = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                sets = rows.field(3)
                sides = [(node[at], part[at], [np.frombuffer(sets[int(k)].as_buffer(), np.uint64) for k in at]) for at in (np.flatnonzero(side == k) for k in (0, 1))]
                found = _edges(sides[0], sides[1] if len(sides[1][0]) else sides[0], percent)
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return sides.mapInArrow(run, "a long, b long")


def name_nodes(sets: DataFrame) -> DataFrame:
    """Adds `node`: the first half of the set's 128-bit name; of sets that differ in the second half alone, all but
    one get a name made of both."""
    clash = sets.where("n > 0").groupBy("s1").agg(F.min("s2").alias("low"), F.max("s2").alias("high")).where("low < high").select("s1", "low")
    if clash.isEmpty():
        return sets.withColumn("node", F.col("s1"))
    named = F.when(F.col("low").isNull() | (F.col("s2") == F.col("low")), F.col("s1")).otherwise(F.xxhash64("s1", "s2"))
    return sets.join(clash, "s1", "left").withColumn("node", named).drop("low")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links, itself included). percent is 50 at least."""
    if not 50 <= percent <= 100:
        raise ValueError("similarities from 50 to 100 percent only")
    scratch = Scratch(docs.sparkSession, "jaccard")
    one_thread(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = name_nodes(scratch.put(_sets(slim, k, percent, _word_cells(slim, "text")), "sets"))
    rows = scratch.put(sets.select("doc_id", "n", "node"), "rows")
    # one row for each set: that of its least id
    first = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))
    one = (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    reps = scratch.put(sets.where("n > 0").join(first.withColumnRenamed("node", "of"), one, "left_semi").select("doc_id", "node", "s1", "s2", "n", "l", "base", "toks"), "reps")
    scratch.drop("sets")

    need = lambda n: F.floor((percent * n + 99) / 100)
    lack = lambda n: n - need(n)
    # what a node lacks in its smallest possible partner
    least_lack = lack(need(F.col("n")))

    def met(tokens: DataFrame) -> DataFrame:
        shared = tokens.groupBy("tok").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("tok")
        return tokens.join(shared, "tok", "left_semi")

    short = F.slice("toks", F.lit(1), (lack(F.col("n")) + F.floor(lack(F.col("n")) / 4) + 1).cast("int"))
    held = met(reps.select("node", F.explode(short).alias("tok"))).groupBy("node").agg(F.count(F.lit(1)).alias("held"))
    held = scratch.put(held, "held")
    able = scratch.put(reps.join(held, "node").where(F.col("held") > F.floor(least_lack / 4)).drop("held").dropDuplicates(["node"]), "able")
    scratch.drop("reps")

    found = scratch.put(met(able.select("node", "n", F.posexplode("toks").alias("pos", "tok"))), "found-0")
    for turn in range(1, PRUNINGS + 1):
        most = found.groupBy("node").agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("n"))
        found = scratch.put(met(found.join(most.where(F.col("held") > least_lack).select("node"), "node", "left_semi")), f"found-{turn}")
        scratch.drop(f"found-{turn - 1}")
    prefix = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "tok"))).alias("p"))
    packed = scratch.put(prefix.join(able.select("node", "doc_id", "s1", "s2", "n", "l", "base"), "node"), "packed")
    scratch.drop("able")

    # lost: shingles before this one that no other prefix holds, so no set that shares this one has them
    keys = packed.select("node", "n", F.posexplode("p").alias("rank", "e")).select("node", "n", "e.tok", "e.pos", (F.col("e.pos") - F.col("rank")).alias("lost"))
    keys = scratch.put(met(keys.where(F.col("pos") <= lack(F.col("n")))), "keys")

    similar = lambda n, n2: 100 * F.least(n, n2) >= percent * F.greatest(n, n2)
    # shingles beyond the prefix
    beyond = lambda n, base, l: F.greatest(F.lit(0), n - (base + l - 1))  # noqa: E731, E741

    def hopeful(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that share as many prefix shingles as they must, and that what lies beyond could link."""
        side = lambda c: packed.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n", "l", "base")), F.col("p.tok").alias(f"{c}_p"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(similar(F.col("a_n"), F.col("b_n")))
        same = F.size(F.array_intersect("a_p", "b_p"))
        least = F.least("a_l", "b_l") + F.least(lack(F.col("a_n")), lack(F.col("b_n")))
        most = same + F.greatest(*(beyond(F.col(f"{c}_n"), F.col(f"{c}_base"), F.col(f"{c}_l")) for c in "ab"))
        short = (F.col("a_base") < 2 * lack(F.col("a_n")) + 1) | (F.col("b_base") < 2 * lack(F.col("b_n")) + 1)
        return both.where((short | (same >= least)) & (most * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n")))).select("a", "b")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            made = [shingle_set(t, k, words) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            halves = [_halves(x) for x in made]
            columns = [*(pa.array([h[j] for h in halves], pa.int64()) for j in (0, 1)), pa.array([len(x) for x in made], pa.int64())]
            columns += [pa.array([f(x) for x in made], pa.binary()) for f in (lambda x: _signature(x, percent), lambda x: _signature(x, percent, FINE), np.ndarray.tobytes)]
            yield pa.RecordBatch.from_arrays(columns, names=["s1", "s2", "n", "sig", "fine", "set"])

    wanted = packed.select(F.col("doc_id").alias("of")).distinct()
    texts = slim.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").select("text")
    full = texts.mapInArrow(whole, "s1 long, s2 long, n long, sig binary, fine binary, set binary").join(packed.select("s1", "s2", "node"), ["s1", "s2"]).select("node", "n", "sig", "fine", "set")
    full = scratch.put(full.dropDuplicates(["node"]), "full")

    def between(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    best = F.min(F.struct("lost", "node"))
    pairs = keys.join(keys.groupBy("tok").agg(best.alias("c")), "tok").where(F.col("node") != F.col("c.node"))
    fresh = scratch.put(hopeful(pairs.select(*between(F.col("node"), F.col("c.node"))).distinct()), "pairs")
    links = scratch.put(_linked(fresh, full, scratch, "links", percent), "links")
    parts = scratch.put(components(links, scratch, "cc"), "parts")
    placed = keys.join(parts.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("part", F.coalesce("component", "node")).drop("of", "component")

    # a partner has `most` shingles or fewer, if this bucket's is the first shingle the two have in common
    placed = placed.withColumn("most", F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n"))
    bounds = placed.groupBy("tok").agg(F.min("n").alias("smallest"), F.max("most").alias("furthest"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").drop("low", "high")
    placed = placed.join(bounds, "tok").where("n <= furthest and smallest <= most").drop("smallest", "furthest")
    bounds = placed.groupBy("tok").agg(F.count(F.lit(1)).alias("c"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").drop("low", "high")
    members = scratch.put(placed.join(bounds, "tok").select("tok", "node", "part", "n", "most", "c"), "open")
    if not members.isEmpty():
        few = members.where(F.col("c") <= SMALL).drop("c")
        other = few.select("tok", *(F.col(c).alias(f"{c}2") for c in few.columns if c != "tok"))
        met_twice = few.join(other, "tok").where((F.col("node") < F.col("node2")) & (F.col("part") != F.col("part2")) & (F.col("n") <= F.col("most2")) & (F.col("n2") <= F.col("most")))
        fresh = met_twice.where(similar(F.col("n"), F.col("n2"))).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
        many = members.where(F.col("c") > SMALL).select("tok", "node", "part", "n", "most")
        last = _linked(scratch.put(hopeful(fresh), "pairs-last"), full, scratch, "last", percent)
        if not many.isEmpty():
            last = last.unionByName(_in_chunks(many, full, scratch, percent))
        # components so far are stars, which only the links between them change
        joined = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(last)
        parts = components(joined, scratch, "cc-last")
    named = first.join(parts.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "rep", F.coalesce("component", "node").alias("part"))
    least = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = named.select(F.col("node").alias("of"), "part").join(least, "part").drop("part")
    placed = rows.where("n > 0").join(named, F.col("node") == F.col("of")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone)


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)


OP7_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
