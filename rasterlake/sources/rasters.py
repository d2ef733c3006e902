"""Raster codecs and kernels in numpy, for use inside Arrow tasks: PNG and BMP in and out, classes, thresholds,
similarity and palettes of one image. Rasters are uint8 arrays of (height, width, 3 or 4)."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .. import constants as K
from ..operators.palette import cut

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def luma(px: np.ndarray) -> np.ndarray:
    c = px[..., :3].astype(np.float64)
    return 0.299 * c[..., 0] + 0.587 * c[..., 1] + 0.114 * c[..., 2]


def on_white(px: np.ndarray) -> np.ndarray:
    if px.shape[2] == 3:
        return px
    a = px[..., 3:].astype(np.float64)
    return np.round((px[..., :3] * a + 255 * (255 - a)) / 255).astype(np.uint8)


def encode_bmp(px: np.ndarray) -> bytes:
    """24 bits, rows from the bottom, each padded to four bytes."""
    h, w = px.shape[:2]
    row = (24 * w + 31) // 32 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : 3 * w] = on_white(px)[::-1, :, ::-1].reshape(h, 3 * w)
    head = struct.pack("<2sIHHI", b"BM", 54 + row * h, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, row * h, 2835, 2835, 0, 0)
    return head + body.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    start, _, w, h, _, bits = struct.unpack_from("<IIiiHH", data, 10)
    if data[:2] != b"BM" or bits != 24:
        raise ValueError("only 24-bit bitmaps are read")
    row = (24 * w + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : 3 * w].reshape(abs(h), w, 3)[..., ::-1]
    return np.ascontiguousarray(body[::-1] if h > 0 else body)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filters(rows: np.ndarray, step: int) -> np.ndarray:
    """The rows (bytes) as each of the five filters codes them: plain, left, above, their mean, the nearest of three."""
    left = np.pad(rows, ((0, 0), (step, 0)))[:, : rows.shape[1]]
    up = np.pad(rows, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(left, ((1, 0), (0, 0)))[:-1]
    a, b, c = (v.astype(np.int16) for v in (left, up, corner))
    far = [np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)]
    nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
    return np.stack([rows, rows - left, rows - up, rows - ((a + b) // 2).astype(np.uint8), rows - nearest])


def _stream(made: np.ndarray, modes: np.ndarray) -> bytes:
    """The rows of chosen filters, each behind its filter's number."""
    return np.concatenate([modes[:, None].astype(np.uint8), made[modes, np.arange(made.shape[1])]], axis=1).tobytes()


def _choices(made: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Filters of the rows by name: one for all, or for each row that of the least sum of differences, or of the least
    entropy."""
    h = made.shape[1]
    found = [(name, np.full(h, k)) for k, name in enumerate(("plain", "left", "above", "mean", "nearest"))]
    found.append(("least differences", np.minimum(made, 0 - made).sum(axis=2, dtype=np.int64).argmin(axis=0)))
    share = np.stack([[np.bincount(row, minlength=256) for row in rows] for rows in made]) / max(1, made.shape[2])
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=2)
    return [*found, ("least entropy", entropy.argmin(axis=0))]


def _packed(index: np.ndarray, depth: int) -> np.ndarray:
    """Samples (h, w) of 1, 2, 4 or 8 bits as rows of bytes."""
    if depth == 8:
        return index.astype(np.uint8)
    planes = (index.astype(np.uint8)[:, :, None] >> np.arange(depth - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(len(index), -1), axis=1)


def _depth(colours: int) -> int:
    return next(d for d in (1, 2, 4, 8) if colours <= 1 << d)


def _indexed(palette: np.ndarray, index: np.ndarray) -> tuple[str, int, int, int, np.ndarray, bytes]:
    """A palette (n, 3 or 4) with the transparent entries first, so that the list of alphas is short."""
    extra = b""
    if palette.shape[1] == 4:
        order = np.argsort(palette[:, 3], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        palette, index = palette[order], place[index]
        extra = palette[: np.count_nonzero(palette[:, 3] < 255), 3].astype(np.uint8).tobytes()
    depth = _depth(len(palette))
    chunks = _chunk(b"PLTE", palette[:, :3].astype(np.uint8).tobytes()) + (_chunk(b"tRNS", extra) if extra else b"")
    return "palette", 3, depth, 1, _packed(index, depth), chunks


def _as_is(px: np.ndarray) -> tuple[str, int, int, int, np.ndarray, bytes]:
    n = px.shape[2]
    return "colour" if n == 3 else "colour and alpha", 2 if n == 3 else 6, 8, n, px.reshape(len(px), px.shape[1] * n), b""


def forms(px: np.ndarray) -> list[tuple[str, int, int, int, np.ndarray, bytes]]:
    """Ways to hold the same pixels: (name, colour type, bits, bytes a pixel, rows, chunks before the data): as they
    are, without an alpha that says nothing, gray with as few bits as its values need, by a palette."""
    h, found = len(px), [_as_is(px)]
    opaque = px.shape[2] == 3 or bool((px[..., 3] == 255).all())
    rgb = px[..., :3]
    if opaque and px.shape[2] == 4:
        found.append(("colour", 2, 8, 3, np.ascontiguousarray(rgb).reshape(h, -1), b""))
    if (rgb[..., 0] == rgb[..., 1]).all() and (rgb[..., 1] == rgb[..., 2]).all():
        gray = rgb[..., 0]
        if opaque:
            depth = next(d for d in (1, 2, 4, 8) if not (gray % (255 // ((1 << d) - 1))).any())
            found.append(("gray", 0, depth, 1, _packed(gray // (255 // ((1 << depth) - 1)), depth), b""))
        else:
            found.append(("gray and alpha", 4, 8, 2, np.ascontiguousarray(px[..., [0, 3]]).reshape(h, -1), b""))
    seen = px[..., : 3 if opaque else 4].reshape(-1, 3 if opaque else 4)
    word = (seen.astype(np.uint32) << (8 * np.arange(seen.shape[1], dtype=np.uint32))).sum(axis=1, dtype=np.uint32)
    if word.size:
        names, index, often = np.unique(word, return_inverse=True, return_counts=True)
        if len(names) <= 256:
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            palette = ((names[order, None] >> (8 * np.arange(seen.shape[1], dtype=np.uint32))) & 255).astype(np.uint8)
            found.append(_indexed(palette, place[index].reshape(px.shape[:2])))
    return found


def _png(w: int, h: int, form: tuple, body: bytes) -> bytes:
    _, kind, depth, _, _, extra = form
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + extra + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def encode_png(px: np.ndarray, palette: np.ndarray | None = None, index: np.ndarray | None = None, level: int = 9) -> bytes:
    """Truecolour, or indexed if a palette is given, one filter for all rows: the quick form of optimised_png."""
    h, w = px.shape[:2]
    if palette is not None and len(palette) <= 256:
        form = ("palette", 3, 8, 1, index.astype(np.uint8), _chunk(b"PLTE", palette.astype(np.uint8).tobytes()))
    else:
        form = _as_is(px)
    made = _filters(form[4], form[3])
    body = min((zlib.compress(_stream(made, np.full(h, m)), level) for m in ((0,) if form[1] == 3 else range(4))), key=len)
    return _png(w, h, form, body)


def optimised_png(px: np.ndarray, palette: np.ndarray | None = None, index: np.ndarray | None = None) -> tuple[bytes, list[tuple[str, int]]]:
    """The smallest lossless PNG found, and the size after each step: the quick form; the best of the ways to hold the
    pixels; filters chosen for each row; other strategies of the compressor. A step is never larger than the last."""
    h, w = px.shape[:2]
    best = encode_png(px, palette, index)
    steps = [("quick", len(best))]
    if not h or not w:
        return best, steps
    options = forms(px)
    if palette is not None and 0 < len(palette) <= 256:
        options.append(_indexed(palette, index))
    # which form is smallest shows already without filters, or with one
    tried = []
    for form in options:
        made = _filters(form[4], form[3])
        body, modes = min(((zlib.compress(_stream(made, np.full(h, m)), 9), m) for m in (0, 4)), key=lambda x: len(x[0]))
        tried.append((len(_png(w, h, form, body)), len(tried), form, made, body))
    tried.sort(key=lambda t: t[:2])
    best = min(best, _png(w, h, tried[0][2], tried[0][4]), key=len)
    steps.append((f"form: {tried[0][2][0]}, {tried[0][2][2]} bits", len(best)))
    streams = []
    for _, _, form, made, _ in tried[:2]:
        for name, modes in _choices(made):
            stream = _stream(made, modes)
            body = zlib.compress(stream, 9)
            streams.append((len(_png(w, h, form, body)), len(streams), name, form, stream, body))
    streams.sort(key=lambda t: t[:2])
    best = min(best, _png(w, h, streams[0][3], streams[0][5]), key=len)
    steps.append((f"filters: {streams[0][2]}", len(best)))
    how = "usual"
    for _, _, _, form, stream, _ in streams[:2]:
        for name, strategy in (("usual", zlib.Z_DEFAULT_STRATEGY), ("filtered", zlib.Z_FILTERED), ("runs", zlib.Z_RLE), ("codes alone", zlib.Z_HUFFMAN_ONLY)):
            packer = zlib.compressobj(9, zlib.DEFLATED, 15, 9, strategy)
            made = _png(w, h, form, packer.compress(stream) + packer.flush())
            if len(made) < len(best):
                best, how = made, name
    steps.append((f"compressor: {how}", len(best)))
    return best, steps


def unfiltered(data: bytes, wide: int, step: int) -> np.ndarray:
    """Rows of `wide` bytes, each coded by the filter that its first byte names; `step` bytes make a pixel."""
    raw = np.frombuffer(data, np.uint8)
    h = len(raw) // (1 + wide)
    raw = raw[: h * (1 + wide)].reshape(h, 1 + wide)
    out = np.zeros((h + 1, wide), np.uint8)
    for y in range(h):
        mode, line, up = raw[y, 0], raw[y, 1:], out[y]
        if mode in (0, 2):
            out[y + 1] = line + (up if mode else 0)
        elif mode == 1 and not wide % step:
            out[y + 1] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        else:
            row = [0] * wide
            above, given = up.tolist(), line.tolist()
            for x in range(wide):
                a, b, c = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
                if mode == 1:
                    guess = a
                elif mode == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[x] = (given[x] + guess) & 255
            out[y + 1] = row
    return out[1:]


def _passes(w: int, h: int, laced: bool) -> list[tuple[int, int, int, int]]:
    """(first column, first row, step across, step down) of each pass over an image; one, or the seven of Adam7."""
    if not laced:
        return [(0, 0, 1, 1)]
    return [p for p in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if p[0] < w and p[1] < h]


def decode_png(data: bytes) -> np.ndarray:
    """Gray, truecolour or indexed, of 1 to 16 bits (of 16 the higher 8 count), with or without alpha or a transparent
    colour, interlaced or not."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, body, palette, clear, depth = 8, [], None, None, 0
    while at + 8 <= len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if depth not in (1, 2, 4, 8, 16) or colour not in (0, 2, 3, 4, 6) or (colour == 3 and palette is None):
        raise ValueError("a PNG of an unknown kind")
    n, raw, used = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour], zlib.decompress(b"".join(body)), 0
    px = np.zeros((h, w, n), np.uint16)
    for x, y, dx, dy in _passes(w, h, bool(lace)):
        pw, ph = -(-(w - x) // dx), -(-(h - y) // dy)
        wide = -(-pw * n * depth // 8)
        rows = unfiltered(raw[used : used + ph * (1 + wide)], wide, max(1, n * depth // 8))
        used += ph * (1 + wide)
        if depth == 16:
            part = rows.reshape(ph, pw, n, 2).astype(np.uint16)
            px[y::dy, x::dx] = part[..., 0] << 8 | part[..., 1]
        elif depth == 8:
            px[y::dy, x::dx] = rows.reshape(ph, pw, n)
        else:
            bits = (rows[:, :, None] >> np.arange(8 - depth, -1, -depth, dtype=np.uint8)) & ((1 << depth) - 1)
            px[y::dy, x::dx] = bits.reshape(ph, -1)[:, : pw * n].reshape(ph, pw, n)
    if colour == 3:
        index = np.minimum(px[..., 0], len(palette) - 1)
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear or b"")] = np.frombuffer((clear or b"")[: len(palette)], np.uint8)
        return palette[index] if clear is None else np.concatenate([palette, alpha[:, None]], axis=1)[index]
    hidden = None
    if clear is not None and colour in (0, 2):
        hidden = (px == np.frombuffer(clear, ">u2")[:n]).all(axis=2)
    px = (px >> 8 if depth == 16 else px * (255 // ((1 << depth) - 1))).astype(np.uint8)
    if colour in (0, 4):
        px = np.concatenate([np.repeat(px[..., :1], 3, axis=2), px[..., 1:]], axis=2)
    return px if hidden is None else np.concatenate([px, np.where(hidden, 0, 255).astype(np.uint8)[..., None]], axis=2)


def decode(data: bytes) -> np.ndarray:
    """The raster of a PNG, JPEG, GIF (its first frame) or bitmap."""
    if data[:3] == b"GIF":
        from .gif import decode as decode_gif

        px = decode_gif(data)
        return px if (px[..., 3] < 255).any() else np.ascontiguousarray(px[..., :3])
    if data[:2] == b"\xff\xd8":
        from .jpeg import decode as decode_jpeg

        return decode_jpeg(data)
    return decode_bmp(data) if data[:2] == b"BM" else decode_png(data)


def resized(px: np.ndarray, w: int, h: int) -> np.ndarray:
    """Each new pixel is the mean of those it covers, or the nearest one where the raster grows."""
    out = px.astype(np.float64)
    for axis, n in ((0, h), (1, w)):
        size = out.shape[axis]
        if n < size:
            edge = np.arange(n + 1) * size // n
            out = np.add.reduceat(out, edge[:-1], axis=axis) / np.diff(edge).reshape([-1 if k == axis else 1 for k in range(3)])
        elif n > size:
            out = np.take(out, (2 * np.arange(n) + 1) * size // (2 * n), axis=axis)
    return np.round(out).astype(np.uint8)


def classify(px: np.ndarray) -> tuple[str, int, float, float]:
    """(class, distinct colours, flatness, extreme ratio) over every so-manieth pixel in raster order."""
    flat = px[..., :3].reshape(-1, 3)[:: max(1, len(px) * px.shape[1] // K.MAX_SAMPLES)]
    if not len(flat):
        return "photo", 0, 0.0, 0.0
    packed = (flat[:, 0].astype(np.int64) << 16) | (flat[:, 1].astype(np.int64) << 8) | flat[:, 2]
    tone = luma(flat)
    unique = min(len(np.unique(packed)), K.UNIQUE_CAP)
    flatness = float(np.count_nonzero(packed[1:] == packed[:-1]) / len(packed))
    extreme = float(np.count_nonzero((tone <= K.NEAR_BLACK) | (tone >= K.NEAR_WHITE)) / len(packed))
    if extreme >= K.BILEVEL_MIN_EXTREME and unique < K.UNIQUE_CAP:
        return "bilevel", unique, flatness, extreme
    return ("flat" if flatness >= K.FLAT_MIN_FLATNESS and unique <= K.FLAT_MAX_COLORS else "photo"), unique, flatness, extreme


def otsu(px: np.ndarray) -> int:
    if px.size == 0:
        return 128
    h = np.bincount(luma(px).astype(np.int64).ravel(), minlength=256).astype(np.float64)
    w, s = np.cumsum(h), np.cumsum(h * np.arange(256))
    front = w[-1] - w
    use = (w > 0) & (front > 0)
    if not use.any():
        return 0
    var = np.full(256, -1.0)
    var[use] = w[use] * front[use] * (s[use] / w[use] - (s[-1] - s[use]) / front[use]) ** 2
    return int(var.argmax())


def bilevel(px: np.ndarray) -> np.ndarray:
    px = on_white(px)
    return (luma(px) <= otsu(px)).astype(np.uint8)


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over full 8x8 windows of the float32 lumas; 1 without any."""
    n = K.SSIM_WINDOW
    h, w = a.shape[0] // n * n, a.shape[1] // n * n
    if not h or not w:
        return 1.0
    x, y = (luma(on_white(p)).astype(np.float32)[:h, :w].astype(np.float64).reshape(h // n, n, w // n, n) for p in (a, b))
    mean = lambda v: v.mean(axis=(1, 3))
    ma, mb = mean(x), mean(y)
    va, vb, cov = mean(x * x) - ma * ma, mean(y * y) - mb * mb, mean(x * y) - ma * mb
    return float((((2 * ma * mb + K.SSIM_C1) * (2 * cov + K.SSIM_C2)) / ((ma * ma + mb * mb + K.SSIM_C1) * (va + vb + K.SSIM_C2))).mean())


def bounded(px: np.ndarray, edge: int) -> np.ndarray:
    """The raster with a long edge of at most `edge`."""
    h, w = px.shape[:2]
    ratio = min(1.0, edge / max(h, w, 1))
    return px if ratio == 1 else resized(px, max(1, int(w * ratio + 0.5)), max(1, int(h * ratio + 0.5)))


class Reference:
    """A raster made ready once for many comparisons, at a long edge of COMPARE_EDGE at most."""

    def __init__(self, px: np.ndarray):
        self.px = bounded(on_white(px), K.COMPARE_EDGE)

    def score(self, other: np.ndarray) -> float:
        return ssim(self.px, bounded(on_white(other), K.COMPARE_EDGE))


def quantize(px: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(raster of palette colours, palette, index). Alpha stays; fully transparent pixels keep their colour."""
    s, mask = 8 - K.BITS, (1 << K.BITS) - 1
    c = px[..., :3].astype(np.int64) >> s
    bins = (c[..., 0] << (2 * K.BITS)) | (c[..., 1] << K.BITS) | c[..., 2]
    seen = px[..., 3] > 0 if px.shape[2] == 4 else np.ones(bins.shape, bool)
    names, n = np.unique(bins[seen], return_counts=True)
    boxes = cut(dict(zip(names.tolist(), n.tolist(), strict=True)), most)
    if not boxes:
        return px, np.zeros((0, 3), np.uint8), np.zeros(bins.shape, np.uint8)
    weight = dict(zip(names.tolist(), n.tolist(), strict=True))
    place = np.zeros(1 << (3 * K.BITS), np.int64)
    palette = np.zeros((len(boxes), 3))
    for k, box in enumerate(boxes):
        place[box] = k
        parts = np.array([[(b >> (K.BITS * (2 - j))) & mask for j in range(3)] for b in box])
        w = np.array([weight[b] for b in box], float)
        palette[k] = ((parts + 0.5) * (1 << s) * w[:, None]).sum(axis=0) / w.sum()
    palette = np.round(palette).astype(np.uint8)  # half to even, as clamped byte stores do
    out = px.copy()
    out[..., :3] = np.where(seen[..., None], palette[place[bins]], px[..., :3])
    return out, palette, place[bins]
