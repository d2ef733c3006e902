"""GIF images: any frame of a file, drawn on the ones before it."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np

from .filters import lzw


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _colours(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _rows(h: int) -> np.ndarray:
    """Where the rows of an interlaced frame go: every eighth, those between, and so on."""
    return np.concatenate([np.arange(start, h, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def pictures(data: bytes) -> Iterator[np.ndarray]:
    """The picture after each frame, as (height, width, 4); pixels that no frame draws are transparent."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    shared, at = _colours(data, 13, flags)
    canvas = np.zeros((h, w, 4), np.uint8)
    clear, disposal = None, 0
    while at < len(data):
        mark = data[at]
        if mark == 0x21:
            body, end = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, clear = body[0] >> 2 & 7, body[3] if body[0] & 1 else None
            at = end
            continue
        if mark != 0x2C:
            break
        x, y, fw, fh, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _colours(data, at + 10, flags)
        palette = own if own is not None else shared
        width = data[at]
        if palette is None or not 1 <= width <= 11:
            raise ValueError("a GIF frame without colours")
        coded, at = _blocks(data, at + 1)
        index = np.frombuffer(lzw(coded, width, low_first=True, early=0).ljust(fw * fh, b"\0")[: fw * fh], np.uint8).reshape(fh, fw)
        if flags & 0x40:
            placed = np.empty_like(index)
            placed[_rows(fh)] = index
            index = placed
        before = canvas.copy()
        part = canvas[y : y + fh, x : x + fw]
        index = index[: part.shape[0], : part.shape[1]]
        rgb = palette[np.minimum(index, len(palette) - 1)]
        drawn = np.ones(index.shape, bool) if clear is None else index != clear
        part[drawn] = np.concatenate([rgb, np.full((*index.shape, 1), 255, np.uint8)], axis=2)[drawn]
        yield canvas.copy()
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            canvas = before
        clear, disposal = None, 0


def decode(data: bytes, frame: int = 0) -> np.ndarray:
    """The picture after so many frames (0: the first). ValueError if the file has fewer or is none."""
    for px in islice(pictures(data), frame, None):
        return px
    raise ValueError("a GIF without such a frame")


def frames(data: bytes) -> int:
    """How many frames a file has."""
    return sum(1 for _ in pictures(data))
