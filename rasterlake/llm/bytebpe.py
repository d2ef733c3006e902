"""Byte-level BPE by a sentencepiece model that is made from a vocabulary, nothing trained.

The vocabulary gives byte strings with ranks. Each becomes a piece of a serialised BPE model: its bytes mapped to 256
characters of their own, its score the negative rank, normalisation the identity. Joining the pair of the best score
first, leftmost of equals, is then the byte-level rule. Texts are cut into pre-tokens by the vocabulary's pattern,
each encoded by itself; decoding maps pieces back to bytes.

A task keeps the codes of the distinct pre-tokens it has met, in a table of bounded size, and works on one text at a
time; nothing is shuffled, and a lost task costs only its own partition.

Defined results: a null text counts as empty (no ids, empty decoded text); bytes that are no UTF-8 count as U+FFFD,
as Python's decoder replaces them; strings that name special tokens are ordinary text; repeated rows each get their
own result; an empty table gives no rows; a long text, or a pre-token of any length, is encoded whole; columns other
than the id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, tokenizer_path

#: Distinct pre-tokens a task remembers before it starts anew, and the longest it remembers: bounds on memory alone.
TABLE_WORDS, LONGEST_KEPT = 300_000, 128
#: Where the 256 characters that stand for bytes begin.
FIRST = 0x100
#: The model's piece 0 is the unknown one, which no text needs; ranks follow.
SHIFT = 1


def ranks(path: str) -> list[bytes]:
    """The vocabulary's byte strings by rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        found = {int(n): base64.b64decode(code) for code, n in map(bytes.split, filter(None, map(bytes.strip, f)))}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [found[n] for n in range(len(found))]


def to_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO)


def to_bytes(piece: str) -> bytes:
    return piece.translate(_FROM).encode("latin-1")


_TO = {b: FIRST + b for b in range(256)}
_FROM = {c: b for b, c in _TO.items()}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _part(number: int, data: bytes) -> bytes:
    """A length-delimited field."""
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def model(vocabulary: list[bytes]) -> bytes:
    """The vocabulary as a serialised sentencepiece model: pieces, the BPE kind, a normaliser that changes nothing."""
    flag = lambda number, v: _varint(number << 3) + _varint(v)
    piece = lambda text, score, kind: _part(1, _part(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", score) + kind)
    pieces = [piece(b"<unk>", 0.0, flag(3, 2))] + [piece(to_characters(p).encode(), -float(n), b"") for n, p in enumerate(vocabulary)]
    # fields of the trainer (3: model type, 2 being BPE) and the normaliser (3 to 5: dummy prefix, extra and escaped spaces)
    return b"".join(pieces) + _part(2, flag(3, 2)) + _part(3, _part(1, b"identity") + flag(3, 0) + flag(4, 0) + flag(5, 0))


class Codec(dict):
    """pre-token -> (ids as decimal bytes, decoded bytes, number of ids)."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        super().__init__()
        vocabulary = ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model(vocabulary))
        self.cut = regex.compile(pattern).findall
        self.whole = {p: n for n, p in enumerate(vocabulary)}
        self.bytes_of = [to_bytes(self.processor.id_to_piece(n + SHIFT)) for n in range(len(vocabulary))]
        self.text_of = [str(n).encode() for n in range(len(vocabulary))]

    def ids(self, word: str) -> list[int]:
        data = word.encode()
        n = self.whole.get(data)
        return [n] if n is not None else [n - SHIFT for n in self.processor.encode(to_characters(data))]

    def __missing__(self, word: str) -> tuple[bytes, bytes, int]:
        ids = self.ids(word)
        made = b" ".join([self.text_of[n] for n in ids]), b"".join([self.bytes_of[n] for n in ids]), len(ids)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= TABLE_WORDS:
                self.clear()
            self[word] = made
        return made

    def encode(self, text: bytes | None) -> tuple[bytes, bytes, int]:
        """A text's ids, decoded bytes, number of ids."""
        found = [self[w] for w in self.cut((text or b"").decode("utf-8", "replace"))]
        return b" ".join([x[0] for x in found]), b"".join([x[1] for x in found]), sum([x[2] for x in found])

    def decode(self, ids: list[int] | None) -> bytes:
        return b"".join([self.bytes_of[n] for n in ids or []])


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", output: str = "digest") -> DataFrame:
    """Encodes and decodes every text.

    output "ids": id, n_tokens, ids array<int>, decoded binary. output "digest": id, n_tokens, ids_sha256 (of the
    decimal ids joined by one space) and decoded_sha256 (of the decoded bytes), both made in the worker, so that ids
    need not travel."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if output == "digest" else ("ids", "decoded"))]
    arrow = [pa.int64(), *((pa.string(), pa.string()) if output == "digest" else (pa.list_(pa.int32()), pa.binary()))]
    spark_kinds = ("string", "string") if output == "digest" else ("array<int>", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            made = []
            for text in batch.column(1).cast(pa.binary()):
                ids, decoded, n = codec.encode(text.as_py())
                made.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()) if output == "digest" else (n, list(map(int, ids.split())), decoded))
            columns = [pa.array([x[k] for x in made], t) for k, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, {names[2]} {spark_kinds[0]}, {names[3]} {spark_kinds[1]}")


def decode_documents(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded binary: the bytes of each row's ids; of null none. An id that the vocabulary lacks is an error."""
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(ids.as_py()) for ids in batch.column(1)], pa.binary())], names=[id_col, "decoded"])

    return coded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def op12_bytebpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
