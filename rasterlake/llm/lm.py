r"""Language-model scoring with a gated recurrent network (gru.py) over a word vocabulary.

Text is lower-cased (A-Z); tokens are the words `[^\x20\x09-\x0D]+` and one end per document. The network
predicts the end, the TOP most frequent words, and GROUPS groups of all other words, by their last two letters.
A word outside the vocabulary gets its group's probability times its share of the group, (c + 1) over the sum of
(c + 1) of the group's training words and 1 for a word not seen: the base model within the group. Base and
network share the counts, which cover all training documents.

Passes. 1: each task cuts its rows into blocks of some MB and writes a block's distinct words with their training
counts, and its documents as places in that list; this is the only pass over texts. Counts are summed up over all
blocks and come back to each (one row per distinct word, not per occurrence); there its documents become the network's
ids, with all that the base model and the words outside the vocabulary add. 2: gradient steps visit every token of
every training document, in one of the rounds, drawn by hash; shards of about SHARD_TOKENS train side by side, and their
weights are averaged after each round. Sequences, shards and counts grow with the input. 3: documents are scored whole,
the state carried from window to window.

Texts are read once, so `docs` may be any plan; `stored` is taken for callers' sake and has no effect.

Defined results: a null or empty text is its end token alone; a null id counts as training; repeated rows are
documents of their own; with no training documents all counts are 0 and the network is untrained; an empty
table gives no rows. Columns other than the id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import Scratch, one_thread, table

TOP, GROUPS = 1983, 64
HIDDEN, CLASSES = 24, 32
SHARD_TOKENS, ROUNDS = 1_500_000, 2
BLOCK_BYTES = 16_000_000
#: Tokens that are scored side by side.
SCORE_TOKENS = 1_000_000
FOLD, FOLDS = 2, 7
_EDGE = b".,;:!?*$%&#|\"'()[]{}"


def held_out(doc: int | None) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % FOLDS == FOLD


def group(word: bytes) -> int:
    return zlib.crc32(word.strip(_EDGE)[-2:]) % GROUPS


def name(word: bytes) -> int:
    """A word's 64-bit hash; the end of a document is the empty word."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, so that no batch is held as Python objects as a whole."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """(block, ids, lower-cased texts), the same in every pass."""
    at = TaskContext.get().partitionId() << 24
    ids, texts, size = [], [], 0
    for batch in _few(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(doc)
            texts.append((text or b"").lower())
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield at, ids, texts
                at, ids, texts, size = at + 1, [], [], 0
    if ids:
        yield at, ids, texts


def _placed(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the end first; all texts' words, each text with its end, as places in that list; tokens of each text."""
    whole = pa.array(texts, pa.binary())
    # the cut is at bytes, so nothing needs to be valid UTF-8
    split = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(whole), whole.buffers()[1], whole.buffers()[2]))
    coded = pc.dictionary_encode(split.flatten())
    places = coded.indices.to_numpy().astype(np.int32)
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    sizes = np.diff(split.offsets.to_numpy())
    if b"" in words:  # what stands before leading and after trailing white space
        none = words.index(b"")
        real = places != none
        sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[real], minlength=len(texts))
        places = places[real]
        places -= places > none
        del words[none]
    return [b"", *words], np.insert(places + np.int32(1), np.cumsum(sizes), 0), sizes + 1


_COLUMNS = "block long, place int, h long, g int, n long, doc long, held boolean, places binary"


def _announced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's words (place, h, g, n) and its documents (doc, held, places as 32-bit numbers); the others' columns are null."""
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("h", pa.int64()), ("g", pa.int32()), ("n", pa.int64()), ("doc", pa.int64()), ("held", pa.bool_()), ("places", pa.binary())])

    def rows(block: int, size: int, **columns: pa.Array) -> pa.RecordBatch:
        some = {"block": pa.array(np.full(size, block), pa.int64())} | columns
        return pa.RecordBatch.from_arrays([some.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

    for block, ids, texts in _blocks(batches):
        words, places, sizes = _placed(texts)
        texts.clear()
        held = np.array([held_out(doc) for doc in ids])
        counts = np.bincount(places[np.repeat(~held, sizes)], minlength=len(words))
        bounds = np.concatenate([[0], np.cumsum(sizes)]) * places.itemsize
        binary = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(places)])
        for k in range(0, len(ids), 2000):
            some = slice(k, k + 2000)
            yield rows(block, len(ids[some]), doc=pa.array(ids[some], pa.int64()), held=pa.array(held[some]), places=binary[some])
        del places, binary
        yield rows(
            block, len(words), place=pa.array(np.arange(len(words), dtype=np.int32)), h=pa.array(np.fromiter(map(name, words), np.int64, len(words))),
            g=pa.array([-1, *map(group, words[1:])], pa.int32()), n=pa.array(counts),
        )


class Vocabulary:
    """The bounded part of the model that every task holds: ids of frequent words, group masses, totals."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum(F.when(F.col("g") < 0, F.col("c"))).alias("ends")).first()
        self.n, self.v, self.ends = int(total["n"] or 0), int(total["v"] or 0), int(total["ends"] or 0)
        top = counts.where("g >= 0 and c > 0").orderBy(F.desc("c"), "h").limit(TOP).collect()
        groups = counts.where("g >= 0 and c > 0").groupBy("g").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).collect()
        count, mass = np.zeros(GROUPS), np.ones(GROUPS)
        for r in groups:
            count[r["g"]], mass[r["g"]] = r["c"], r["c"] + r["k"] + 1
        for r in top:
            count[r["g"]] -= r["c"]
            mass[r["g"]] -= r["c"] + 1
        self.first_group = len(top) + 1
        self.ids = [(name(b""), 0), *((r["h"], k + 1) for k, r in enumerate(top))]
        self.log_mass = np.log10(mass)
        self.counts = np.concatenate([[self.ends], [r["c"] for r in top], np.maximum(count, 0)])
        self.shape = gru.shape(self.counts, HIDDEN, CLASSES)


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binaries, and where each row begins, with the end."""
    column = column.combine_chunks().cast(pa.binary())
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)
    return data, (offsets - offsets[0]) // np.dtype(kind).itemsize


def _coder(vocabulary: Vocabulary):
    """A block's documents as the network's ids (from the end before the first word on), with all that counts alone tell."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        import xxhash

        ids = docs.column("doc").to_pylist()
        place = counts.column("place").to_numpy()
        c, model = np.zeros(len(place), np.int64), np.zeros(len(place), np.int16)
        c[place], model[place] = counts.column("c").to_numpy(), counts.column("m").to_numpy()
        base = np.log10(c + 1) - math.log10(vocabulary.n + vocabulary.v + 1)
        inside = np.where(model < vocabulary.first_group, 0.0, np.log10(c + 1) - vocabulary.log_mass[np.maximum(model - vocabulary.first_group, 0)])
        places, at = _joined(docs.column("places"), np.int32)
        first = at[:-1]
        summed = [np.add.reduceat(x[places], first) for x in ((c > 0).astype(np.int64), base, inside)]
        coded = np.insert(model[places], first, 0)
        bounds = pa.py_buffer(((at + np.arange(len(at))) * 2).astype(np.int32))
        keys = [(xxhash.xxh3_64_intdigest(f"{doc}".encode()) >> 1) & ((1 << 62) - 1) for doc in ids]
        made = [pa.array(ids, pa.int64()), docs.column("held").combine_chunks(), pa.array(np.diff(at), pa.int64()), *map(pa.array, summed), pa.array(keys, pa.int64()), pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, bounds, pa.py_buffer(coded)])]
        return pa.table(made, names=["doc", "held", "n_tokens", "n_known", "base", "inside", "key", "model"])

    return run


def _trainer(s: gru.Shape, weights: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [np.frombuffer(x, np.int16) for batch in batches for x in batch.column(1).to_pylist()]
        if not runs:
            return
        p, tokens = gru.train(gru.unpack(s, weights), s, (runs[k : k + gru.LANES] for k in range(0, len(runs), gru.LANES)))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([gru.pack(p)], pa.binary()), pa.array([tokens], pa.int64())], names=["p", "n"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, tokens = None, 0
    for batch in batches:
        for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            more = np.frombuffer(p, np.float32).astype(np.float64) * n
            total, tokens = more if total is None else total + more, tokens + n
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary()), pa.array([tokens], pa.int64())], names=["p", "n"])


def fit(coded: DataFrame, vocabulary: Vocabulary, scratch: Scratch, rounds: int = ROUNDS) -> bytes:
    """Trains by averaging shards; `coded` has documents as _coder makes them. The result has a fixed size."""
    s = vocabulary.shape
    weights = gru.pack(gru.fresh(s, vocabulary.counts))
    if not vocabulary.n:
        return weights
    shards = max(1, math.ceil(vocabulary.n / SHARD_TOKENS))
    sequences = scratch.put(coded.where("not held").select("key", F.col("model").alias("ids")), "sequences")
    for k in range(rounds):
        part = sequences.where(F.pmod("key", F.lit(rounds)) == k).repartitionById(shards, F.pmod(F.shiftright("key", 8), F.lit(shards)).cast("int")).sortWithinPartitions("key")
        trained = scratch.put(part.mapInArrow(_trainer(s, weights), "p binary, n long"), f"weights-{k}")
        # a bounded number of sums reaches the driver, whatever the number of shards
        sums = trained.coalesce(min(shards, 16)).mapInArrow(_summed, "p binary, n long").collect()
        if sums:
            n = sum(r["n"] for r in sums)
            weights = sum(np.frombuffer(r["p"], np.float32).astype(np.float64) * (r["n"] / n) for r in sums).astype(np.float32).tobytes()
    return weights


def _scorer(vocabulary: Vocabulary, weights: bytes, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, p = vocabulary.shape, gru.unpack(vocabulary.shape, weights)

        def scored(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            docs = pa.Table.from_batches(some)
            data, at = _joined(docs.column("model"), np.int16)
            score = gru.score(p, s, [data[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]) / math.log(10) + docs.column("inside").to_numpy()
            kept = [docs.column(k).combine_chunks() for k in ("doc", "held", "n_tokens", "n_known", "base")]
            return pa.RecordBatch.from_arrays([*kept[:4], pa.array(np.full(len(docs), vocabulary.n), pa.int64()), kept[4], pa.array(score)], names=names)

        some, tokens = [], 0
        for batch in _few(batches):
            some.append(batch)
            tokens += pc.sum(batch.column(2)).as_py()
            if tokens >= SCORE_TOKENS:
                yield scored(some)
                some, tokens = [], 0
        if some:
            yield scored(some)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, stored: bool = True) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score; logarithms to base 10."""
    scratch = Scratch(docs.sparkSession, "lm")
    one_thread(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    blocks = scratch.put(slim.mapInArrow(_announced, _COLUMNS), "blocks")
    words, texts = blocks.where("n is not null"), blocks.where("n is null").select(F.col("block").alias("own"), "doc", "held", "places")
    counts = scratch.put(words.groupBy("h").agg(F.sum("n").alias("c"), F.min("g").alias("g")), "counts")
    vocabulary = Vocabulary(counts)
    top = docs.sparkSession.createDataFrame(vocabulary.ids, "h long, m int")
    model = counts.join(F.broadcast(top), "h", "left").select("h", "c", F.coalesce("m", F.col("g") + vocabulary.first_group).cast("int").alias("m"))
    back = words.select("h", "block", "place").join(model, "h").select("block", "place", "c", "m")
    columns = "doc long, held boolean, n_tokens long, n_known long, base double, inside double, key long, model binary"
    coded = scratch.put(texts.groupBy("own").cogroup(back.groupBy("block")).applyInArrow(_coder(vocabulary), columns), "coded")
    for done in ("blocks", "counts"):
        scratch.drop(done)
    weights = fit(coded, vocabulary, scratch, rounds)
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return coded.select("doc", "held", "n_tokens", "n_known", "base", "inside", "model").mapInArrow(_scorer(vocabulary, weights, names), schema)


def op4_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
