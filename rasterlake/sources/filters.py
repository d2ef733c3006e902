"""Stream codings of documents and images: LZW in both bit orders, run lengths, base 85 and 16, byte predictors.

All are plain functions of bytes for use inside Arrow tasks; input that ends early gives what it holds.
"""

from __future__ import annotations

import re
import zlib

import numpy as np


def lzw(data: bytes, width: int = 8, low_first: bool = False, early: int = 1) -> bytes:
    """Bytes of a variable-length code stream. Codes of `width` + 1 bits come first; code 2 ** width starts anew, the
    next one ends. low_first: bits come from the low end of bytes, as in GIF; `early`: codes widen so many entries
    before they must."""
    clear, stop = 1 << width, (1 << width) + 1
    fresh = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, size, before = list(fresh), width + 1, None
    out, held, bits = [], 0, 0
    for byte in data:
        held, bits = (held | byte << bits, bits + 8) if low_first else (held << 8 | byte, bits + 8)
        while bits >= size:
            bits -= size
            if low_first:
                code, held = held & (1 << size) - 1, held >> size
            else:
                code, held = held >> bits, held & (1 << bits) - 1
            if code == stop:
                return b"".join(out)
            if code == clear:
                table, size, before = list(fresh), width + 1, None
                continue
            if code < len(table):
                found = table[code]
            elif code == len(table) and before is not None:
                found = before + before[:1]
            else:
                raise ValueError("an LZW code that isn't defined yet")
            out.append(found)
            if before is not None and len(table) < 4096:
                table.append(before + found[:1])
            before = found
            if len(table) + early >= 1 << size and size < 12:
                size += 1
    return b"".join(out)


def run_lengths(data: bytes) -> bytes:
    """Copies of 1 to 128 bytes and runs of 2 to 128; 128 ends."""
    out, at = [], 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
    return b"".join(out)


def base85(data: bytes) -> bytes:
    text = re.sub(rb"[\s\0]", b"", data).split(b"~")[0].replace(b"z", b"!!!!!")
    if re.search(rb"[^!-u]", text):
        raise ValueError("a character that base 85 lacks")
    short = -len(text) % 5
    digits = np.frombuffer(text + b"u" * short, np.uint8).reshape(-1, 5).astype(np.uint64) - 33
    words = (digits * np.array([85**4, 85**3, 85**2, 85, 1], np.uint64)).sum(axis=1)
    return words.astype(">u4").tobytes()[: len(words) * 4 - short]


def base16(data: bytes) -> bytes:
    text = re.sub(rb"[\s\0]", b"", data).split(b">")[0]
    return bytes.fromhex((text + b"0" * (len(text) % 2)).decode("ascii"))


def unpredicted(data: bytes, parms: dict[str, str]) -> bytes:
    """Undoes the differences to neighbours that the parameters name: 2 within rows, 10 and more a filter each row."""
    from . import rasters

    kind = int(parms.get("Predictor", "1"))
    if kind == 1:
        return data
    colours, depth = int(parms.get("Colors", "1")), int(parms.get("BitsPerComponent", "8"))
    wide = -(-int(parms.get("Columns", "1")) * colours * depth // 8)
    if kind >= 10:
        return rasters.unfiltered(data, wide, max(1, colours * depth // 8)).tobytes()
    if kind != 2 or depth not in (8, 16):
        raise ValueError("a predictor of another kind")
    rows = np.frombuffer(data, np.uint8 if depth == 8 else ">u2", len(data) // wide * wide // (depth // 8)).reshape(-1, wide // colours // (depth // 8), colours)
    return np.cumsum(rows, axis=1, dtype=rows.dtype.newbyteorder("=")).astype(rows.dtype).tobytes()


#: Filters of PDF streams by both of their names, but those of images.
_NAMES = {"Fl": "FlateDecode", "LZW": "LZWDecode", "RL": "RunLengthDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}


def names(entry: dict[str, str]) -> list[str]:
    """A stream's filters, in the order in which they are undone."""
    return [_NAMES.get(n, n) for n in re.findall(r"/([^\s\[\]/<>()]+)", entry.get("Filter", entry.get("F", "")))]


def parameters(entry: dict[str, str], n: int) -> list[dict[str, str]]:
    """The parameters of each of n filters."""
    from . import pdf

    text = entry.get("DecodeParms", entry.get("DP", "")).encode("latin-1").strip()
    if not text.startswith(b"["):
        return ([pdf.entries(text)] + [{}] * n)[:n]
    found, at = [], 1
    for start, end in pdf.tokens(text, 1):
        if start < at:
            continue
        if text[start:end] == b"]":
            break
        at = pdf.value_end(text, start)
        found.append(pdf.entries(text[start:at]))
    return (found + [{}] * n)[:n]


def undone(entry: dict[str, str], data: bytes) -> tuple[bytes, list[tuple[str, dict[str, str]]]]:
    """A stream's bytes without its codings, up to the first that is an image's or isn't known; what is left of them,
    with parameters."""
    chain = list(zip(found := names(entry), parameters(entry, len(found)), strict=True))
    while chain:
        name, parms = chain[0]
        if name == "FlateDecode":
            data = zlib.decompressobj().decompress(data)
        elif name == "LZWDecode":
            data = lzw(data, early=int(parms.get("EarlyChange", "1")))
        elif name == "RunLengthDecode":
            data = run_lengths(data)
        elif name == "ASCII85Decode":
            data = base85(data)
        elif name == "ASCIIHexDecode":
            data = base16(data)
        else:
            break
        if name in ("FlateDecode", "LZWDecode"):
            data = unpredicted(data, parms)
        chain.pop(0)
    return data, chain
