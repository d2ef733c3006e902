"""Quality rules: word rules and compression bands.

Base rules, on words `[^\\x20\\x09-\\x0D]+` of the whole text: at least MIN_WORDS words, and at most
MAX_REPEAT_PERCENT percent of them in 8-word windows that the text holds twice or more.

Compression bands: the zstandard ratio (compressed by raw bytes) of the whole text, and of each fixed chunk of
it, must lie in a band chosen by the length of what is compressed. Below the band the text is
repetitive, above it incompressible. A text fails if its own ratio is outside, or if more than
MAX_ODD_CHUNKS of its chunks are. What is left after the last full chunk is looked at with the bytes before it,
as the text's last chunk; a text shorter than a chunk has none.

Defined results: a null or empty text has no words and all counts 0; it fails the base rule. Repeated rows
each get their own result; an empty table gives no rows; columns other than the id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WS, table

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
LEVEL, CHUNK_BYTES, MAX_ODD_CHUNKS = 3, 4096, 0.25
#: From so many bytes on: lowest and highest ratio allowed. Short texts carry the frame's overhead.
BANDS = ((0, 0.45, 2.00), (256, 0.45, 0.95), (512, 0.45, 0.90), (1024, 0.43, 0.85), (2048, 0.41, 0.80), (4096, 0.39, 0.75), (8192, 0.35, 0.72), (32768, 0.32, 0.70))
CHUNK_BAND = (0.42, 0.80)

_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_odd_chunks long"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of so many words that occur twice or more, each word once."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    # exact names for runs of 1, 2, 4, ... words: a pair of names of the half as long runs
    have, names = 1, ids
    while have < window:
        step = min(have, window - have)
        pair = names[: len(names) - step] * (int(names.max()) + 1) + names[step:]
        names = np.unique(pair, return_inverse=True)[1]
        have += step
    again = np.bincount(names)[names] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def measure(text: bytes, compressor, bands=BANDS, chunk_band=CHUNK_BAND) -> tuple:
    """The columns of _FIELDS for one text."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - (len(text) - len(text.decode())) if n else 0
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(WS)]
    again = repeat_words(words)
    failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
    ratio = len(compressor.compress(text)) / len(text) if text else 0.0
    chunks = odd = 0
    starts = [*range(0, len(text) - CHUNK_BYTES + 1, CHUNK_BYTES)]
    if starts and starts[-1] + CHUNK_BYTES < len(text):
        starts.append(len(text) - CHUNK_BYTES)
    for k in starts:
        chunks += 1
        odd += not chunk_band[0] <= len(compressor.compress(text[k : k + CHUNK_BYTES])) / CHUNK_BYTES <= chunk_band[1]
    _, low, high = [x for x in bands if x[0] <= len(text)][-1]
    kept = not failed and low <= ratio <= high and odd <= MAX_ODD_CHUNKS * chunks
    return n, chars, symbols, len(lines) - len(set(lines)), again, failed, kept, ratio, chunks, odd


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk_band=CHUNK_BAND) -> DataFrame:
    """Every document's measures and verdict."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(f.split()[0] for f in _FIELDS.split(", "))]
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    kinds = [arrow[f.split()[1]] for f in _FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = [measure(t or b"", compressor, bands, chunk_band) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {_FIELDS}")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
