"""Compression, conversion and analysis of image files: one row in, one row out, no shuffle.

Rows are large, so a task works on one at a time. Errors of a file become its status. Encoders that this engine
lacks (WebP, AVIF) give the status `unsupported`; nothing is written in another format instead. Classes and
similarities are measured on rasters of bounded size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import constants as K

_RESULT = "path string, status string, image_class string, technique string, format_label string, original_bytes long, new_bytes long, reduction_pct double, ssim double, width int, height int, hit_target boolean, content binary"
_NAMES = [f.split()[0] for f in _RESULT.split(", ")]
_ARROW = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]


def _mapped(images: DataFrame, work, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = work(path, content)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return images.select("path", "content").mapInArrow(run, schema)


def visual_quality(px, floor: float) -> tuple[bytes, float, float] | None:
    """The JPEG of the lowest quality that keeps the similarity floor: (bytes, quality, similarity), None if none does.

    Similarity grows with quality, so the first grid value that holds on a proxy of bounded size is found by
    bisection. The proxy only says where to look: at full size the quality is raised until the floor is kept, or
    lowered while it is, a few steps at most."""
    from ..sources import jpeg
    from ..sources import rasters as R

    lo, hi = K.VISUAL_QUALITIES
    h, w = px.shape[:2]
    ratio = min(1.0, (K.PROXY_MAX_PIXELS / (w * h)) ** 0.5)
    proxy = px if ratio == 1 else R.resized(px, max(K.MIN_DIMENSION, int(w * ratio + 0.5)), max(K.MIN_DIMENSION, int(h * ratio + 0.5)))
    small, whole = R.Reference(proxy), R.Reference(px)
    value = lambda k: lo + k * (hi - lo) / 2**K.VISUAL_STEPS

    def full(quality: float) -> tuple[bytes, float, float]:
        data, back = jpeg.encode(px, quality)
        return data, quality, whole.score(back)

    most = 2**K.VISUAL_STEPS
    k = bisect.bisect_left(range(1, most), floor, key=lambda k: small.score(jpeg.encode(proxy, value(k))[1])) + 1
    if k == most and small.score(jpeg.encode(proxy, hi)[1]) < floor:
        best = full(hi)
        return best if best[2] >= floor else None
    tries = [min(hi, value(k) + j * K.VERIFY_STEP) for j in range(K.VERIFY_ATTEMPTS + 1)]
    best = next((made for made in map(full, dict.fromkeys(tries)) if made[2] >= floor), None)
    for _ in range(K.VERIFY_ATTEMPTS):
        if best is None or best[1] <= lo:
            break
        lower = full(max(lo, best[1] - K.VERIFY_STEP))
        if lower[2] < floor:
            break
        best = lower
    return best


def fitted_jpeg(px, most: int) -> tuple[bytes, int, int, float]:
    """(bytes, width, height, quality) of a JPEG of at most so many bytes: the largest scale at a good quality, or
    else the best quality at the least scale, or else the smallest of all that was tried."""
    from ..sources import jpeg
    from ..sources import rasters as R
    from .documents import largest_fit

    h, w = px.shape[:2]
    tried: dict[tuple[float, float], tuple[bytes, int, int, float]] = {}

    def size(scale: float, quality: float) -> int:
        if (scale, quality) not in tried:
            sides = [max(K.MIN_DIMENSION, int(x * scale + 0.5)) for x in (w, h)]
            tried[scale, quality] = (jpeg.encode(R.resized(px, *sides), quality)[0], *sides, quality)
        return len(tried[scale, quality][0])

    least, steps = K.IMAGE_LEAST_SCALE, K.SCALE_STEPS
    scale = largest_fit(lambda v: size(v, K.PRIMARY_QUALITY), least, 1.0, steps, most)
    if scale is not None:
        return tried[scale, K.PRIMARY_QUALITY]
    quality = largest_fit(lambda v: size(least, v), K.READABLE_QUALITY, K.PRIMARY_QUALITY, steps, most)
    if quality is None:
        q = K.READABLE_QUALITY / 2
        while size(least, q) > most and q > K.POOREST_QUALITY:
            q = max(K.POOREST_QUALITY, q / 2)
        return min(tried.values(), key=lambda t: len(t[0]))
    return tried[least, quality]


def compress_visual(data: bytes, min_ssim: float) -> tuple:
    """The smallest of a JPEG (opaque photos), of the palettes that keep the floor (tried from large to small until one
    fails) and of the lossless form; the original if none is smaller."""
    from ..sources import rasters as R

    px = R.decode(data)
    kind = R.classify(R.bounded(px, K.ANALYSE_EDGE))[0]
    made = [("lossless-png", R.optimised_png(px)[0], 1.0, "PNG")]
    if kind != "photo":
        tried, whole = [], R.Reference(px)
        for size in K.PALETTE_SIZES:
            out, palette, index = R.quantize(px, size)
            score = whole.score(out)
            if score < min_ssim:
                break
            opaque = px.shape[2] == 3
            tried.append((len(R.encode_png(out, palette if opaque else None, index)), out, palette if opaque else None, index, score))
        if tried:  # only the smallest palette is worth the effort
            _, out, palette, index, score = min(tried, key=lambda t: t[0])
            made.insert(0, ("palette", R.optimised_png(out, palette, index)[0], score, "PNG"))
    elif px.shape[2] == 3 and (best := visual_quality(px, min_ssim)):
        made.insert(0, ("ssim-search", best[0], best[2], "JPG"))
    technique, best, score, label = min(made, key=lambda m: len(m[1]))  # the first of equals: a palette before lossless
    return px, kind, technique, best, score, label


def compress_images(images: DataFrame, min_ssim: float | None = None, target_bytes: int | None = None, fmt: str | None = None) -> DataFrame:
    """Reports and contents, for a similarity floor or a size target in bytes. With a target `fmt` names the format:
    JPEG is fitted by scale and quality, PNG and BMP by scale; by default JPEG for opaque photos, PNG for others."""
    floor = K.SSIM_PRESETS["balanced"] if min_ssim is None else min_ssim

    def to_target(px, kind: str, most: int) -> tuple[bytes, int, int, str]:
        from ..sources import rasters as R

        form = fmt or ("jpeg" if kind == "photo" and px.shape[2] == 3 else "png")
        if form == "jpeg":
            return *fitted_jpeg(R.on_white(px), most)[:3], form
        tried = []
        w, h = px.shape[1], px.shape[0]
        for _ in range(K.SHRINK_ATTEMPTS):
            out = R.resized(px, w, h)
            tried.append((R.encode_bmp(out) if form == "bmp" else R.encode_png(out), w, h))
            if len(tried[-1][0]) <= most:
                break
            w, h = int(w * K.SHRINK + 0.5), int(h * K.SHRINK + 0.5)
            if min(w, h) < K.MIN_DIMENSION:
                break
        return *min(tried, key=lambda t: len(t[0])), form

    def work(path: str, data: bytes) -> tuple:
        from ..sources import rasters as R

        n = len(data)
        if fmt and not K.ENCODERS.get(fmt):
            return path, "unsupported", None, None, None, n, None, None, None, None, None, None, None
        try:
            score, hit = None, None
            if target_bytes is None:
                px, kind, technique, best, score, label = compress_visual(data, floor)
                h, w = px.shape[:2]
            else:
                px = R.decode(data)
                kind = R.classify(R.bounded(px, K.ANALYSE_EDGE))[0]
                if n <= target_bytes and (fmt is None or K.FORMATS[fmt][0] == media_type(data)):
                    return path, "done", kind, "untouched", "original", n, n, 0.0, None, px.shape[1], px.shape[0], True, data
                best, w, h, form = to_target(px, kind, min(target_bytes, n))
                technique, label, hit = "lossy-resample", K.FORMATS[form][2], len(best) <= target_bytes
            if len(best) >= n and fmt is None:
                return path, "done", kind, "untouched", "original", n, n, 0.0, 1.0, px.shape[1], px.shape[0], None if hit is None else n <= target_bytes, data
            return path, "done", kind, technique, label, n, len(best), (n - len(best)) / n * 100, score, w, h, hit, best
        except Exception as e:
            return path, f"error: {e}"[:200], None, None, None, n, None, None, None, None, None, None, None

    return _mapped(images, work, _RESULT, _NAMES, _ARROW)


def media_type(data: bytes) -> str | None:
    """By the first bytes of a file."""
    marks = {b"\x89PNG": "image/png", b"\xff\xd8\xff": "image/jpeg", b"BM": "image/bmp", b"GIF8": "image/gif"}
    return next((kind for mark, kind in marks.items() if data.startswith(mark)), None)


def convert_images(images: DataFrame, fmt: str, quality: float = K.PRIMARY_QUALITY) -> DataFrame:
    """path, status, content in another format; opaque formats are put on white. Only JPEG has a quality, from 0 to 1."""
    if not 0 <= quality <= 1:
        raise ValueError("a quality is from 0 to 1")

    def work(path: str, data: bytes) -> tuple:
        from ..sources import jpeg
        from ..sources import rasters as R

        if not K.ENCODERS.get(fmt):
            return path, "unsupported", None
        try:
            px = R.decode(data)
            if fmt == "jpeg":
                return path, "done", jpeg.encode(R.on_white(px), quality)[0]
            return path, "done", R.encode_bmp(px) if fmt == "bmp" else R.encode_png(px)
        except Exception as e:
            return path, f"error: {e}"[:200], None

    return _mapped(images, work, "path string, status string, content binary", ["path", "status", "content"], [pa.string(), pa.string(), pa.binary()])


def analyse_images(images: DataFrame) -> DataFrame:
    """path, status, class, distinct colours, flatness, extreme ratio, threshold, Group 4 size of the bitmap."""
    names = ["path", "status", "image_class", "unique_colors", "flatness", "extreme_ratio", "threshold", "g4_bytes"]

    def work(path: str, data: bytes) -> tuple:
        from ..sources import rasters as R
        from . import g4

        try:
            px = R.decode(data)
            return path, "done", *R.classify(R.bounded(px, K.ANALYSE_EDGE)), R.otsu(R.on_white(px)), len(g4.encode(R.bilevel(px)))
        except Exception as e:
            return path, f"error: {e}"[:200], None, None, None, None, None, None

    schema = "path string, status string, image_class string, unique_colors int, flatness double, extreme_ratio double, threshold int, g4_bytes int"
    return _mapped(images, work, schema, names, [pa.string()] * 3 + [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32()])


def optimise_images(images: DataFrame) -> DataFrame:
    """path, status, original_bytes, new_bytes, steps, content: each image as the smallest lossless PNG found, with the
    size after each step; a PNG that gets no smaller stays as it is."""
    names = ["path", "status", "original_bytes", "new_bytes", "steps", "content"]

    def work(path: str, data: bytes) -> tuple:
        from ..sources import rasters as R

        try:
            best, steps = R.optimised_png(R.decode(data))
            best = data if media_type(data) == "image/png" and len(data) <= len(best) else best
            return path, "done", len(data), len(best), [{"step": step, "bytes": n} for step, n in steps], best
        except Exception as e:
            return path, f"error: {e}"[:200], None if data is None else len(data), None, None, data

    schema = "path string, status string, original_bytes long, new_bytes long, steps array<struct<step:string,bytes:long>>, content binary"
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("step", pa.string()), ("bytes", pa.int64())])), pa.binary()]
    return _mapped(images, work, schema, names, kinds)
