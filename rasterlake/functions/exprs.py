"""Scalar functions as Column expressions; all of them stay inside generated code.

Rounding is floor(x + 0.5) throughout, not half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def js_round(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def reduction_pct(original: Column, new: Column) -> Column:
    """Percent saved; 0 if there was nothing. Nulls stay null."""
    return F.when(original <= 0, F.lit(0.0)).otherwise((original - new) / F.when(original > 0, original) * 100)


def format_bytes(n: Column) -> Column:
    """B, KB, MB, GB with one decimal under 100, in integer arithmetic (ties go up)."""
    n = n.cast("long")
    text = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        size = 1024**power
        tenths = F.floor((n * 20 + size) / (2 * size))
        whole = F.concat(F.floor((2 * n + size) / (2 * size)).cast("string"), F.lit(f" {unit}"))
        part = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        text = F.when(n >= size, F.when(n >= 100 * size, whole).otherwise(part)).otherwise(text)
    return F.when(n <= 0, F.lit("0 B")).otherwise(text)


def parse_size(value: Column, unit: Column) -> Column:
    return F.when(unit == "KB", value * 1024).otherwise(value * 1024 * 1024)


def strip_extension(name: Column) -> Column:
    """Cuts at the last dot unless it comes first."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def ref_key(ref: Column) -> Column:
    """`12R` and `12R3` to `12_0` and `12_3`; null if it is no reference."""
    number = F.regexp_extract(ref, r"^(\d+)R(\d*)$", 1)
    generation = F.regexp_extract(ref, r"^(\d+)R(\d*)$", 2)
    return F.when(number != "", F.concat_ws("_", number, F.when(generation == "", F.lit("0")).otherwise(generation)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def gray_of_unit(v: Column) -> Column:
    """A component around zero as a gray 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 256 + 128).cast("int")))


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def rgb_bin(r: Column, g: Column, b: Column) -> Column:
    s = 8 - K.BITS
    return F.shiftleft(F.shiftright(r, s), 2 * K.BITS).bitwiseOR(F.shiftleft(F.shiftright(g, s), K.BITS)).bitwiseOR(F.shiftright(b, s))


def bin_axis(b: Column, axis: int) -> Column:
    return F.shiftright(b, K.BITS * (2 - axis)).bitwiseAND(F.lit((1 << K.BITS) - 1))


def flatten_white(c: Column, alpha: Column) -> Column:
    return (c * alpha + 255 * (255 - alpha)) / 255


def image_dims(w: Column, h: Column, scale: Column) -> tuple[Column, Column]:
    """Each axis on its own, never under 16."""
    return tuple(F.greatest(F.lit(K.MIN_DIMENSION), js_round(n * scale)) for n in (w, h))


def page_image_dims(w: Column, h: Column, scale: Column, floor_edge: int = K.MIN_LONG_EDGE) -> tuple[Column, Column]:
    """The long edge never goes under `floor_edge`, or under itself if it is shorter."""
    edge = F.greatest(w, h)
    ratio = F.greatest(edge * scale, F.least(edge, F.lit(floor_edge)).cast("double")) / edge
    return tuple(F.greatest(F.lit(1), js_round(n * ratio)) for n in (w, h))


def compare_dims(w: Column, h: Column) -> tuple[Column, Column]:
    edge = F.greatest(w, h)
    made = lambda n: F.when(edge <= K.COMPARE_EDGE, F.greatest(F.lit(1), n).cast("long")).otherwise(F.greatest(F.lit(1), js_round(n * (F.lit(float(K.COMPARE_EDGE)) / edge))))
    return made(w), made(h)


def effective_dpi(w: Column, h: Column, width_pt: Column, height_pt: Column) -> Column:
    """Null if either extent is unknown or zero."""
    known = (F.coalesce(width_pt, F.lit(0.0)) != 0) & (F.coalesce(height_pt, F.lit(0.0)) != 0)
    return F.when(known, F.greatest(w / (width_pt / 72), h / (height_pt / 72)))


def dpi_scale(dpi: Column, most: float) -> Column:
    return F.when(dpi.isNull() | (dpi <= most), F.lit(1.0)).otherwise(F.lit(float(most)) / dpi)


def proxy_ratio(w: Column, h: Column) -> Column:
    return F.least(F.lit(1.0), F.sqrt(F.lit(float(K.PROXY_MAX_PIXELS)) / (w.cast("double") * h)))


def page_scale(w: Column, h: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(float(K.PAGE_MAX_EDGE)) / F.greatest(w, h))


def base_scale(pages: Column) -> Column:
    return F.when(pages > K.BASE_SCALE_PAGES, F.lit(K.BASE_SCALE_LONG)).otherwise(F.lit(K.BASE_SCALE))


def bmp_bytes(w: Column, h: Column) -> Column:
    return F.lit(54) + F.floor((24 * w + 31) / 32) * 4 * h


def image_class(unique: Column, flatness: Column, extreme: Column) -> Column:
    """Bilevel is tried before flat."""
    bilevel = (extreme >= K.BILEVEL_MIN_EXTREME) & (unique < K.UNIQUE_CAP)
    flat = (flatness >= K.FLAT_MIN_FLATNESS) & (unique <= K.FLAT_MAX_COLORS)
    return F.when(bilevel, "bilevel").when(flat, "flat").otherwise("photo")


def auto_format(image_class_: Column) -> Column:
    return F.when(image_class_ == "photo", "webp").otherwise("png")


def format_field(fmt: Column, which: int) -> Column:
    """0 MIME, 1 extension, 2 label of a format name."""
    return F.create_map(*(F.lit(x) for k, v in K.FORMATS.items() for x in (k, v[which])))[fmt]


def output_name(name: Column, kind: Column, label: Column, chosen: Column) -> Column:
    """Documents get `-compressed.pdf`; images the extension of what came out, else of what was chosen."""
    stem = strip_extension(name)
    by_label = F.create_map(*(F.lit(x) for v in K.FORMATS.values() for x in (v[2].lower(), v[1])))[F.lower(label)]
    ext = F.coalesce(by_label, F.when(chosen != "auto", format_field(chosen, 1)))
    return F.when(kind == "pdf", F.concat(stem, F.lit("-compressed.pdf"))).when(ext.isNotNull(), F.concat(stem, F.lit("."), ext)).otherwise(name)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def percent_label(share: Column) -> Column:
    return F.concat(js_round(share * 100).cast("string"), F.lit("%"))


def target_within(target: Column, size: Column) -> Column:
    """A target is never above the file itself."""
    return F.least(target, size)


def savings_fraction(pct: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), pct / 100))


def keep_original(new: Column, original: Column) -> Column:
    return new >= original


def media_kind(mime: Column) -> Column:
    """image, pdf, or null for what is not taken in."""
    return F.when(mime.startswith("image/"), "image").when(mime == "application/pdf", "pdf")
