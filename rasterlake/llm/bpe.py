"""BPE encoding and decoding by a distinct-word table.

Texts are cut into blocks of some MB. Each block gives its distinct words (split at white space), dealt by hash into
buckets; a bucket holds a word for all blocks, so that each distinct word is encoded once, and gives every block the ids of
its words in their order. These meet again by block, and the blocks' texts, read a second time, are joined with them. To
decode, the distinct ids of each block are joined with the vocabulary's id-to-piece table.

What travels are distinct words and ids of blocks, not words of texts, as one compressed list for each block and bucket: a
frequent word goes once for a block. Texts travel once, compressed in parts, and are nowhere written besides. A task holds
the distinct words of one block and the texts of one part of it.

A block is named by its task and its number there, so `docs` must give the same rows in the same tasks twice, as a stored
table does; without `stored=True` it is written first. A block whose words aren't those it gave before stops the job.

A white-space cut is safe for vocabularies whose pre-tokenizer drops white space: no token, contraction or added token
spans a cut, and normalisation to NFC composes nothing with a space.

Defined results: a null text counts as empty (no ids, empty decoded text); a text of white space has no ids; bytes that
are no UTF-8 count as U+FFFD; repeated rows each get their own result; a text longer than a block is a block by itself,
encoded whole; an empty table gives no rows; columns other than the id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few_rows, n_partitions, table, tokenizer_path

#: Bytes of text in a block, beyond which no further text joins it, and in a part of a block.
BLOCK_BYTES, PART_BYTES = 16_000_000, 1_000_000
LEVEL = 3


class Blocks:
    """Texts as blocks that come in parts: one string of bytes for each part, compressed, with the length of each text."""

    @staticmethod
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes], pa.DataType]]:
        """(block, ids, texts, type of ids) for each part, parts of a block one after another, the same in every pass."""
        at = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        held, part, kind = 0, 0, None
        for batch in batches:
            kind = batch.column(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = text.as_py() or b""
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = text.decode("utf-8", "replace").encode()
                full = held and held + len(text) > BLOCK_BYTES
                if texts and (full or part + len(text) > PART_BYTES):
                    yield at, ids, texts, kind
                    ids, texts, part = [], [], 0
                if full:
                    at, held = at + 1, 0
                ids.append(i)
                texts.append(text)
                held, part = held + len(text), part + len(text)
        if texts:
            yield at, ids, texts, kind

    @staticmethod
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL)
        for at, ids, texts, kind in Blocks.of(batches):
            columns = [pa.array([at], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(texts))], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "sizes", "z"])

    @staticmethod
    def texts(sizes: list[int], z: bytes) -> list[bytes]:
        import zstandard

        text = zstandard.ZstdDecompressor().decompress(z, max_output_size=sum(sizes))
        ends = np.cumsum([0, *sizes]).tolist()
        return [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    @staticmethod
    def buckets(found: set[bytes], n: int) -> list[list[bytes]]:
        """A block's distinct words by bucket, each in order."""
        dealt: list[list[bytes]] = [[] for _ in range(n)]
        for word in found:
            dealt[zlib.crc32(word) % n].append(word)
        for words in dealt:
            words.sort()
        return dealt


def block_words(docs: DataFrame, n: int) -> DataFrame:
    """(block, bucket, words): the distinct words of each block by bucket, as compressed lists, from (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL)
        for block, parts in groupby(Blocks.of(batches), itemgetter(0)):
            found: set[bytes] = set()
            for _, _, texts, _ in parts:
                for text in texts:
                    found.update(text.split())
            dealt = [(k, pack.compress(b" ".join(words))) for k, words in enumerate(Blocks.buckets(found, n)) if words]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(dealt), pa.int64()), pa.array([k for k, _ in dealt], pa.int32()), pa.array([z for _, z in dealt], pa.binary())], names=["block", "bucket", "words"])

    return docs.mapInArrow(run, "block long, bucket int, words binary")


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(block, bucket, crc, n, ids) of words by bucket (block, bucket, words), a bucket to a task: its distinct words are
    encoded once. ids: how many each of the n words has, then all of them, compressed; crc: of these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        held = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        for bucket in sorted({b for _, b, _ in held}):
            lists = [(block, unpack.decompress(z)) for block, b, z in held if b == bucket]
            distinct = sorted(set().union(*(words.split() for _, words in lists)))
            tokenizer = _tokenizer(path)
            encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
            made = [m.ids for k in range(0, len(distinct), 10_000) for m in encode([w.decode() for w in distinct[k : k + 10_000]], add_special_tokens=False)]
            size = np.array([len(m) for m in made], np.int64)
            start, flat = np.cumsum(size) - size, np.fromiter(chain.from_iterable(made), np.uint32)
            place = dict(zip(distinct, range(len(distinct)), strict=True))
            del made
            columns: list[list] = [[] for _ in range(5)]
            for block, words in lists:
                at = np.fromiter(map(place.__getitem__, words.split()), np.int64)
                n = size[at]
                ids = flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                # planes of bytes, of which the upper ones are nearly all 0
                z = pack.compress(np.concatenate([n.astype(np.uint32), ids]).view(np.uint8).reshape(-1, 4).T.tobytes())
                for c, x in zip(columns, (block, bucket, zlib.crc32(words), len(at), z), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "bucket", "crc", "n", "ids"])

    return words.mapInArrow(run, "block long, bucket int, crc long, n int, ids binary")


def unpacked(z: bytes) -> np.ndarray:
    """The numbers of an `ids` of encoded_words()."""
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    return np.ascontiguousarray(data.reshape(4, -1).T).view(np.uint32).ravel()


def pieces(spark, path: str) -> DataFrame:
    """(id, piece): the vocabulary with its added tokens, whose size is fixed. A task reads it, so that the driver doesn't
    hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(vocabulary.values()), pa.int32()), pa.array(list(vocabulary.keys()), pa.string())], names=["id", "piece"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "id int, piece string")


def decoded_ids(tables: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(block, id, piece as lists) of each block's distinct ids, by joining these with their pieces; from (block, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some: list[np.ndarray] = []
                for words, z in zip(t.values.field("n").to_pylist(), t.values.field("ids"), strict=True):
                    some.append(np.unique(unpacked(z.as_py())[words:]))
                ids = np.unique(np.concatenate(some)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block), pa.int64()), pa.array(ids)], names=["block", "id"])

    each = tables.select("block", "t").mapInArrow(run, "block long, id int")
    # one row for each entry of a vocabulary: a size that doesn't grow with the corpus
    met = each.join(F.broadcast(vocabulary), "id").groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("p"))
    return met.select("block", F.col("p.id").alias("id"), F.col("p.piece").alias("piece"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", output: str = "digest", stored: bool = False) -> DataFrame:
    """Encodes and decodes every text.

    output "ids": id, n_tokens, ids array<int>, decoded string. output "digest": id, n_tokens, ids_sha256 (of
    the decimal ids joined by one space) and decoded_sha256 (of the decoded text), both made in the worker so
    that ids need not travel.
    """
    scratch = Scratch(docs.sparkSession, "bpe")
    few_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    if not stored:
        slim = scratch.put(slim, "docs")
    buckets = n_partitions(docs.sparkSession)
    words = block_words(slim, buckets).repartitionById(buckets, "bucket")
    coded = encoded_words(words, path).select("block", F.struct("bucket", "crc", "n", "ids").alias("t"))
    tables = scratch.put(coded.groupBy("block").agg(F.collect_list("t").alias("t")), "tables")
    tables = tables.join(decoded_ids(tables, pieces(docs.sparkSession, path)), "block", "left")
    blocks = slim.mapInArrow(Blocks.packed, f"block long, ids array<{kind}>, sizes array<long>, z binary")

    def run(parts: pa.Table, table: pa.Table) -> pa.Table:
        """A block's parts and its words' ids. Texts become Python objects for one part at a time."""
        sizes, packed = parts.column("sizes"), parts.column("z")
        found: set[bytes] = set()
        for k in range(parts.num_rows):
            for text in Blocks.texts(sizes[k].as_py(), packed[k].as_py()):
                found.update(text.split())
        dealt = dict(enumerate(Blocks.buckets(found, buckets)))
        del found
        coded: dict[bytes, tuple[bytes, bytes, int]] = {}
        for k in range(table.num_rows):
            number, piece = table.column("id")[k], table.column("piece")[k]
            told: dict[int, tuple[bytes, bytes]] = {}
            if number.is_valid:
                told = {i: (str(i).encode(), p.encode()) for i, p in zip(number.values.to_pylist(), piece.values.to_pylist(), strict=True)}
            for part in table.column("t")[k].values:
                own, numbers = dealt.pop(part["bucket"].as_py(), []), unpacked(part["ids"].as_py()).tolist()
                if zlib.crc32(b" ".join(own)) != part["crc"].as_py():
                    raise RuntimeError("a block holds other words than before: its rows differ between passes; leave out stored=True")
                end = len(own)
                for word, n in zip(own, numbers[: len(own)], strict=True):
                    if n:
                        both = [told[i] for i in numbers[end : end + n]]
                        coded[word] = (*both[0], 1) if n == 1 else (b" ".join([x[0] for x in both]), b" ".join([x[1] for x in both]), n)
                        end += n
        if any(dealt.values()):
            raise RuntimeError("a block holds words that it did not give before: its rows differ between passes; leave out stored=True")
        made = []
        for k in range(parts.num_rows):
            texts = Blocks.texts(sizes[k].as_py(), packed[k].as_py())
            rows = []
            for text in texts:
                have = [x for x in map(coded.get, text.split()) if x]
                a, b = b" ".join([x[0] for x in have]), b" ".join([x[1] for x in have])
                count = sum([x[2] for x in have])
                rows.append((count, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()) if output == "digest" else (count, list(map(int, a.split())), b.decode()))
            made.append(pa.table([parts.column("ids")[k].values, *(pa.array([x[c] for x in rows], t) for c, t in enumerate(arrow))], names=names))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(made)

    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if output == "digest" else ("ids", "decoded"))]
    arrow = [pa.int64(), *((pa.string(), pa.string()) if output == "digest" else (pa.list_(pa.int32()), pa.string()))]
    kinds = ("string", "string") if output == "digest" else ("array<int>", "string")
    schema = f"`{id_col}` {kind}, n_tokens long, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}"
    return blocks.groupBy("block").cogroup(tables.groupBy("block")).applyInArrow(run, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), stored=True)
