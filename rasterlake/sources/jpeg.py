"""JPEG in and out, in numpy: for use inside Arrow tasks. The coder writes baseline streams with Huffman tables made to
measure; baseline and progressive streams of 8 bits are read, of one, three or four components."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# fixed values: quantisation tables of ITU-T T.81, Annex K, row by row
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
#: Positions of a block in zigzag order: by diagonal, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_K = np.arange(8)
_DCT = np.sqrt(np.where(_K == 0, 1, 2)[:, None] / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)


def tables(quality: float) -> tuple[np.ndarray, np.ndarray]:
    """Quantisation tables for a quality from 0 to 1, on the usual scale of percent."""
    q = min(100, max(1, round(quality * 100)))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return tuple(np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE))


def _planes(px: np.ndarray) -> list[np.ndarray]:
    """Luma, and chroma at half the size, each padded by its edge to whole blocks of a 16-pixel unit."""
    h, w = px.shape[:2]
    rgb = np.pad(px[..., :3], ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge").astype(np.float64)
    r, g, b = (rgb[..., k] for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    half = lambda p: p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean(axis=(1, 3))
    return [y - 128, half((b - y) / 1.772), half((r - y) / 1.402)]


def _blocks(plane: np.ndarray, unit: int) -> np.ndarray:
    """(n, 64) blocks in the order of coding: units of `unit` by `unit` blocks, row by row."""
    h, w = plane.shape[0] // (8 * unit), plane.shape[1] // (8 * unit)
    return plane.reshape(h, unit, 8, w, unit, 8).transpose(0, 3, 1, 4, 2, 5).reshape(-1, 64)


def _plane(blocks: np.ndarray, h: int, w: int, unit_y: int, unit_x: int) -> np.ndarray:
    return blocks.reshape(h, w, unit_y, unit_x, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(h * unit_y * 8, w * unit_x * 8)


def _forward(blocks: np.ndarray) -> np.ndarray:
    return (_DCT @ blocks.reshape(-1, 8, 8) @ _DCT.T).reshape(-1, 64)


def _backward(blocks: np.ndarray) -> np.ndarray:
    return (_DCT.T @ blocks.reshape(-1, 8, 8) @ _DCT).reshape(-1, 64)


def _rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    y = y + 128
    r, b = y + 1.402 * cr, y + 1.772 * cb
    g = (y - 0.299 * r - 0.114 * b) / 0.587
    return np.clip(np.round(np.stack([r, g, b], axis=2)), 0, 255).astype(np.uint8)


def huffman_lengths(counts: np.ndarray, most: int = 16) -> np.ndarray:
    """Optimal code lengths of at most `most` bits, by merging packages of equal cost level by level. One more
    symbol than counted takes the code of all ones, which may not be used."""
    symbols = np.flatnonzero(counts).tolist()
    leaves = sorted([(1, (256,))] + [(int(counts[s]) + 1, (s,)) for s in symbols])
    level: list[tuple[int, tuple]] = []
    for _ in range(most):
        paired = [(level[k][0] + level[k + 1][0], level[k][1] + level[k + 1][1]) for k in range(0, len(level) - 1, 2)]
        level = list(heapq.merge(leaves, paired, key=lambda x: x[0]))
    lengths = np.zeros(257, np.int64)
    for _, names in level[: 2 * len(leaves) - 2]:
        for s in names:
            lengths[s] += 1
    return lengths


def _table(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table's segment body, and code and length of each symbol."""
    lengths = huffman_lengths(counts)
    if not counts.any():
        lengths[0] = 1
    longest = lengths.max()
    # the spare symbol comes last among the longest
    if lengths[256]:
        at = int(np.flatnonzero(lengths[:256] == longest)[-1]) if (lengths[:256] == longest).any() else None
        if at is not None:
            lengths[256], lengths[at] = longest, lengths[at]
    order = sorted((int(n), s) for s, n in enumerate(lengths) if n)
    codes, code, last = np.zeros(257, np.int64), 0, 0
    for n, s in order:
        code <<= n - last
        last, codes[s] = n, code
        code += 1
    real = [(n, s) for n, s in order if s < 256]
    body = bytes(sum(n == k for n, _ in real) for k in range(1, 17)) + bytes(s for _, s in real)
    return body, codes[:256], lengths[:256]


def _size(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _tokens(blocks: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
    """(order, is AC, symbol, extra bits, their number) of the blocks' zigzag values; number: place in the scan."""
    dc = np.diff(blocks[:, 0], prepend=0)
    n = _size(dc)
    out = [[number * 256, np.zeros_like(dc), n, np.where(dc < 0, dc + (1 << n) - 1, dc), n]]
    row, col = np.nonzero(blocks[:, 1:])
    v = blocks[:, 1:][row, col]
    first = np.diff(row, prepend=-1) != 0
    gap = col - np.where(first, -1, np.concatenate([[0], col[:-1]])) - 1 if len(col) else col
    n, order = _size(v), number[row] * 256 + 4 * col + 4
    out.append([order + 3, np.ones_like(v), (gap % 16) * 16 + n, np.where(v < 0, v + (1 << n) - 1, v), n])
    for k in (1, 2, 3):  # runs of sixteen zeros
        some = gap >= 16 * k
        zero = np.zeros(int(some.sum()), np.int64)
        out.append([order[some] + k - 1, zero + 1, zero + 0xF0, zero, zero])
    last = np.zeros(len(blocks), np.int64)
    last[row] = col + 1
    some = number[last < 63]
    out.append([some * 256 + 255, np.ones_like(some), np.zeros_like(some), np.zeros_like(some), np.zeros_like(some)])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def encode(px: np.ndarray, quality: float) -> tuple[bytes, np.ndarray]:
    """A baseline stream with chroma at half size, and the raster that it decodes to."""
    h, w = px.shape[:2]
    if max(h, w) > 65535 or min(h, w) < 1:
        raise ValueError("a JPEG has sides of 1 to 65535 pixels")
    quant = tables(quality)
    planes, kept, back = _planes(px), [], []
    for k, plane in enumerate(planes):
        q = quant[min(k, 1)]
        v = np.round(_forward(_blocks(plane, 2 if k == 0 else 1)) / q).astype(np.int64)
        v[:, 1:] = np.clip(v[:, 1:], -1023, 1023)
        kept.append(v[:, ZIGZAG])
        back.append(_backward(v * q))
    units = len(kept[1])
    number = [np.arange(units * 4) // 4 * 6 + np.arange(units * 4) % 4, np.arange(units) * 6 + 4, np.arange(units) * 6 + 5]
    parts = [_tokens(b, n) for b, n in zip(kept, number, strict=True)]
    kind = np.concatenate([np.full(len(p[0]), min(k, 1)) for k, p in enumerate(parts)])
    order, ac, symbol, extra, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.argsort(order, kind="stable")
    kind, ac, symbol, extra, bits = (x[at] for x in (kind, ac, symbol, extra, bits))
    code, size, huffman = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), b""
    for k in (0, 1):
        for a in (0, 1):
            use = (kind == k) & (ac == a)
            body, codes, lengths = _table(np.bincount(symbol[use], minlength=256))
            huffman += bytes([a << 4 | k]) + body
            code[use], size[use] = codes[symbol[use]], lengths[symbol[use]]
    value, width = (code << bits) | extra, size + bits
    ends = np.cumsum(width)
    place = np.arange(ends[-1]) - np.repeat(ends - width, width)
    stream = ((np.repeat(value, width) >> (np.repeat(width, width) - 1 - place)) & 1).astype(np.uint8)
    stream = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    frame = struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out += b"".join(_segment(0xDB, bytes([k]) + bytes(q[ZIGZAG].tolist())) for k, q in enumerate(quant))
    out += _segment(0xC0, frame) + _segment(0xC4, huffman) + _segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0]))
    uy, ux = planes[1].shape[0] // 8, planes[1].shape[1] // 8
    full = [_plane(back[0], uy, ux, 2, 2), *(np.repeat(np.repeat(_plane(b, uy, ux, 1, 1), 2, axis=0), 2, axis=1) for b in back[1:])]
    return out + stream + b"\xff\xd9", _rgb(*full)[:h, :w]


class _Bits:
    """Bits of an entropy-coded segment, most significant first; ones follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8

    def take(self, n: int) -> int:
        self.need(n)
        self.n -= n
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v

    def symbol(self, table: list) -> int:
        self.need(16)
        n, s = table[self.held >> (self.n - 16)]
        if not n:
            raise ValueError("a code that no table has")
        self.n -= n
        self.held &= (1 << self.n) - 1
        return s

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _lookup(lengths: bytes, symbols: bytes) -> list:
    """(code length, symbol) by the next sixteen bits."""
    out, at, k = [(0, 0)] * 65536, 0, 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            span = 1 << (16 - n)
            out[at : at + span] = [(n, symbols[k])] * span
            at, k = at + span, k + 1
    return out


class _Scan:
    """One scan's parameters, tables and state while it is read into coefficient lists."""

    def __init__(self, bits: _Bits, first: int, last: int, high: int, low: int):
        self.bits, self.first, self.last, self.high, self.low, self.run = bits, first, last, high, low, 0

    def whole(self, values: list, at: int, part: dict) -> None:
        """A block of a sequential scan."""
        bits, k = self.bits, 1
        part["before"] += bits.signed(bits.symbol(part["dc"]))
        values[at] = part["before"]
        table = part["ac"]
        while k < 64:
            s = bits.symbol(table)
            if not s & 15:
                if s != 0xF0:
                    return
                k += 16
                continue
            k += s >> 4
            if k > 63:
                raise ValueError("a block with too many values")
            values[at + k] = bits.signed(s & 15)
            k += 1

    def dc(self, values: list, at: int, part: dict) -> None:
        if self.high:
            values[at] |= self.bits.take(1) << self.low
        else:
            part["before"] += self.bits.signed(self.bits.symbol(part["dc"]))
            values[at] = part["before"] * (1 << self.low)

    def _ends(self, r: int) -> bool:
        """Whether a symbol without a value ends the band, here and in so many blocks to come."""
        if r == 15:
            return False
        self.run = (1 << r) + (self.bits.take(r) if r else 0)
        return True

    def ac(self, values: list, at: int, part: dict) -> None:
        """A band's first bits."""
        bits, k = self.bits, self.first
        if not self.run:
            while k <= self.last:
                s = bits.symbol(part["ac"])
                if s & 15:
                    k += s >> 4
                    if k > 63:
                        raise ValueError("a block with too many values")
                    values[at + k] = bits.signed(s & 15) * (1 << self.low)
                    k += 1
                elif self._ends(s >> 4):
                    break
                else:
                    k += 16
        self.run = max(0, self.run - 1)

    def ac_more(self, values: list, at: int, part: dict) -> None:
        """One more bit of a band: values known so far get theirs as they are passed, new ones are of one bit."""
        bits, k, one = self.bits, self.first, 1 << self.low
        while not self.run and k <= self.last:
            s = bits.symbol(part["ac"])
            zeros, fresh = s >> 4, 0
            if s & 15:
                fresh = one if bits.take(1) else -one
            elif self._ends(zeros):
                break
            k = self._passed(values, at, k, zeros)
            if fresh and k <= self.last:
                values[at + k] = fresh
            k += 1
        if self.run:
            self._passed(values, at, k, 64)
            self.run -= 1

    def _passed(self, values: list, at: int, k: int, zeros: int) -> int:
        """The place after so many zeros; each value on the way takes its bit."""
        one = 1 << self.low
        while k <= self.last:
            v = values[at + k]
            if not v:
                if not zeros:
                    break
                zeros -= 1
            elif self.bits.take(1) and not abs(v) & one:
                values[at + k] = v + (one if v > 0 else -one)
            k += 1
        return k


def _entropy_coded(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The scan's bytes between restarts, and where the next marker is."""
    segments, start = [], at
    while True:
        k = data.find(b"\xff", at)
        if k < 0 or k + 1 >= len(data):
            return [*segments, data[start:]], len(data)
        if data[k + 1] == 0xFF:
            at = k + 1
            continue
        if data[k + 1] and not 0xD0 <= data[k + 1] <= 0xD7:
            return [*segments, data[start:k]], k
        if data[k + 1]:
            segments.append(data[start:k])
            start = k + 2
        at = k + 2


def _blocks_of(parts: list[dict], chosen: list[dict], w: int, h: int) -> list[list[tuple[dict, int]]]:
    """The units of a scan: for each, (component, block) in order. One component alone is scanned without padding."""
    mx, my = max(p["x"] for p in parts), max(p["y"] for p in parts)
    if len(chosen) == 1:
        (p,) = chosen
        wide, high = -(-(-(-w * p["x"] // mx)) // 8), -(-(-(-h * p["y"] // my)) // 8)
        return [[(p, y * p["wide"] + x)] for y in range(high) for x in range(wide)]
    ux, uy = -(-w // (8 * mx)), -(-h // (8 * my))
    return [[(p, (y * p["y"] + j) * p["wide"] + x * p["x"] + i) for p in chosen for j in range(p["y"]) for i in range(p["x"])] for y in range(uy) for x in range(ux)]


def _read(data: bytes) -> tuple[list[dict], dict[int, np.ndarray], int, int, int | None]:
    """Components with their coefficients, quantisation tables, width, height, the colour transform that is named."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    quant: dict[int, np.ndarray] = {}
    codes: dict[int, list] = {}
    parts: list[dict] = []
    at, adobe, restart, progressive, scans = 2, None, 0, False, 0
    w = h = 0
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if scans and (at + 4 > len(data) or data[at] != 0xFF or data[at + 1] == 0xD9):
            break
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a JPEG without a scan")
        mark, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                q = np.zeros(64, np.int64)
                q[ZIGZAG] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8)
                quant[body[0] & 15], body = q, body[1 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]], body = _lookup(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif mark in (0xC0, 0xC1, 0xC2):
            progressive = mark == 0xC2
            depth, h, w, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3, 4) or not w or not h:
                raise ValueError("only JPEGs of 8 bits and one, three or four components are read")
            parts = [{"id": body[6 + 3 * k], "x": body[7 + 3 * k] >> 4, "y": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(n)]
            if n == 1:
                parts[0]["x"] = parts[0]["y"] = 1
            mx, my = max(p["x"] for p in parts), max(p["y"] for p in parts)
            for p in parts:
                p["wide"], p["high"] = -(-w // (8 * mx)) * p["x"], -(-h // (8 * my)) * p["y"]
                p["values"] = [0] * (64 * p["wide"] * p["high"])
        elif 0xC3 <= mark <= 0xCF and mark != 0xC8:
            raise ValueError("only baseline and progressive JPEGs are read")
        elif mark == 0xDD:
            (restart,) = struct.unpack(">H", body[:2])
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark == 0xDA:
            if not parts:
                raise ValueError("a scan without a frame")
            n, chosen = body[0], []
            for k in range(n):
                p = next((p for p in parts if p["id"] == body[1 + 2 * k]), None)
                if p is None:
                    raise ValueError("a scan of an unknown component")
                p["dc"], p["ac"] = codes.get(body[2 + 2 * k] >> 4, []), codes.get(0x10 | body[2 + 2 * k] & 15, [])
                chosen.append(p)
            first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            if progressive and (first == 0) != (last == 0) or last > 63 or first > last or first and n > 1:
                raise ValueError("a scan of an impossible band")
            segments, at = _entropy_coded(data, at)
            units, done = _blocks_of(parts, chosen, w, h), 0
            for segment in segments:
                scan = _Scan(_Bits(segment.replace(b"\xff\x00", b"\xff")), first, last, high, low)
                step = scan.whole if not progressive else scan.dc if not first else scan.ac_more if high else scan.ac
                for p in chosen:
                    p["before"] = 0
                for unit in units[done : done + (restart or len(units))]:
                    for p, block in unit:
                        step(p["values"], 64 * block, p)
                done += restart or len(units)
            scans += 1
    return parts, quant, w, h, adobe


def samples(data: bytes) -> tuple[np.ndarray, bool]:
    """(height, width, components) of a stream: gray, RGB, or four inks as they are stored; and whether an Adobe marker
    says that inks are stored inverted. Coarser components are repeated."""
    parts, quant, w, h, adobe = _read(data)
    mx, my = max(p["x"] for p in parts), max(p["y"] for p in parts)
    full = []
    for p in parts:
        v = np.zeros((p["wide"] * p["high"], 64))
        v[:, ZIGZAG] = np.array(p["values"], np.float64).reshape(-1, 64)
        plane = _plane(_backward(v * quant[p["q"]]), p["high"], p["wide"], 1, 1)
        if mx % p["x"] or my % p["y"]:
            raise ValueError("components of uneven sizes")
        full.append(np.repeat(np.repeat(plane, my // p["y"], axis=0), mx // p["x"], axis=1)[:h, :w])
    level = lambda planes: np.clip(np.round(np.stack(planes, axis=2) + 128), 0, 255).astype(np.uint8)
    plain = adobe == 0 or (adobe is None and (len(parts) == 4 or bytes(p["id"] for p in parts) == b"RGB"))
    if len(full) == 1 or plain:
        return level(full), adobe is not None
    made = _rgb(*full[:3])
    return (made if len(full) == 3 else np.concatenate([made, level(full[3:])], axis=2)), adobe is not None


def from_inks(cmyk: np.ndarray) -> np.ndarray:
    """RGB of four inks (255: all of it): what an ink and black leave of each colour."""
    k = cmyk[..., 3:].astype(np.int64)
    return (255 - np.minimum(255, cmyk[..., :3] + k)).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The raster of a baseline or progressive stream."""
    px, inverted = samples(data)
    if px.shape[2] == 1:
        return np.repeat(px, 3, axis=2)
    return px if px.shape[2] == 3 else from_inks(255 - px if inverted else px)
