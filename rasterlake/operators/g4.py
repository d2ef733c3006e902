"""Two-dimensional facsimile coding (ITU-T T.6) of bitmaps: a numpy kernel, and a decoder that checks it.

The coder is a state machine along each row, so it is a row-wise Arrow task: no shuffle, one bitmap at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import runs as R


def _run_bits(length: int, black: int) -> str:
    bits = []
    while length >= 2624:
        bits.append(R.SHARED_MAKEUP[-1])
        length -= 2560
    if length >= 64:
        own = R.BLACK_MAKEUP if black else R.WHITE_MAKEUP
        k = length // 64
        bits.append(own[k - 1] if k <= 27 else R.SHARED_MAKEUP[k - 28])
        length %= 64
    bits.append((R.BLACK_TERMINATING if black else R.WHITE_TERMINATING)[length])
    return "".join(bits)


def _edges(row: np.ndarray, width: int) -> np.ndarray:
    """Changing elements and, after them, the width three times, so that every look-up finds something."""
    at = np.flatnonzero(np.diff(row, prepend=0))
    return np.append(at, [width] * 3)


def encode(bitmap: np.ndarray) -> bytes:
    """bitmap: rows of 0 (white) and 1 (black)."""
    width = bitmap.shape[1]
    out: list[str] = []
    above = np.array([width] * 3)
    for row in bitmap.astype(np.int8):
        own = _edges(row, width)
        a0, colour = -1, 0
        while a0 < width:
            k = int(np.searchsorted(own[:-3], a0, "right"))
            a = k + ((k & 1) != colour)
            j = int(np.searchsorted(above[:-3], a0, "right"))
            j += (j & 1) != colour
            a1, b1, b2 = int(own[a]), int(above[j]), int(above[j + 1])
            if b2 < a1:
                out.append(R.PASS)
                a0 = b2
            elif abs(a1 - b1) <= 3:
                out.append(R.VERTICAL[a1 - b1])
                a0, colour = a1, 1 - colour
            else:
                a2 = int(own[a + 1])
                out += (R.HORIZONTAL, _run_bits(a1 - max(a0, 0), colour), _run_bits(a2 - a1, 1 - colour))
                a0 = a2
        above = own
    bits = "".join(out) + R.END
    return np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()


def decode(data: bytes, width: int, height: int) -> np.ndarray:
    """The bitmap of a coded stream. Rows that the stream doesn't hold stay white."""
    bits = "".join(map(str, np.unpackbits(np.frombuffer(data, np.uint8))))
    codes = {c: ("v", d) for d, c in R.VERTICAL.items()} | {R.PASS: ("p", 0), R.HORIZONTAL: ("h", 0)}
    tables = []
    for end, makeup in ((R.WHITE_TERMINATING, R.WHITE_MAKEUP), (R.BLACK_TERMINATING, R.BLACK_MAKEUP)):
        tables.append({c: k for k, c in enumerate(end)} | {c: 64 * (k + 1) for k, c in enumerate(makeup)} | {c: 1792 + 64 * k for k, c in enumerate(R.SHARED_MAKEUP)})
    at = 0

    def read(table: dict):
        nonlocal at
        for n in range(1, 14):
            if bits[at : at + n] in table:
                at += n
                return table[bits[at - n : at]]
        raise ValueError(f"no code at bit {at}")

    def run(colour: int) -> int:
        total = 0
        while True:
            k = read(tables[colour])
            total += k
            if k < 64:
                return total

    out = np.zeros((height, width), np.uint8)
    above: list[int] = []
    for y in range(height):
        if at >= len(bits) or bits.startswith(R.END, at):
            break
        a0, colour = -1, 0
        while a0 < width:
            j = bisect_right(above, a0)
            j += j % 2 != colour
            b1, b2 = (above[k] if k < len(above) else width for k in (j, j + 1))
            kind, d = read(codes)
            start = max(a0, 0)
            if kind == "p":
                out[y, start:b2] = colour
                a0 = b2
            elif kind == "v":
                out[y, start : b1 + d] = colour
                a0, colour = b1 + d, 1 - colour
            else:
                for c in (colour, 1 - colour):
                    n = run(c)
                    out[y, start : start + n] = c
                    start += n
                a0 = start
        row = out[y]
        above = np.flatnonzero(np.diff(row.astype(np.int8), prepend=0)).tolist()
    return out


def g4_encode(bitmaps: DataFrame, id_col: str, bits: str, width: int) -> DataFrame:
    """(id, code) of bit strings whose rows are `width` wide."""
    kind = bitmaps.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode((np.frombuffer(b, np.uint8) - 48).reshape(-1, width)) for b in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[id_col, "code"])

    return bitmaps.select(id_col, bits).mapInArrow(run, f"`{id_col}` {kind}, code binary")
