"""A PDF reader and writer: takes documents apart into a table of objects, and puts such a table together again.

The reader goes through the file from one object to the next, so that bytes of a stream are never taken for
structure; object streams are read, and of objects that are defined again the last counts. Encrypted files are told
as errors. Values stay as they are written; only a dictionary's own entries are taken apart.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .. import constants as K
from ..operators import g4
from . import filters, jpeg, rasters

_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
_REF = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+R\b")
_TOKEN = re.compile(rb"[\s\0]+|%[^\r\n]*|<<|>>|\[|\]|\(|<[^<>]*>|/[^\s\0<>\[\](){}/%]*|\d+\s+\d+\s+R\b|[^\s\0<>\[\]()/%]+|.", re.S)
_PAREN = re.compile(rb"\\.|[()]", re.S)


#: Objects in an object stream at most: readers unpack a stream whole, and its index has two bytes.
PACKED = 1000
#: Pixels of an image at most; one of more isn't decoded, as a task holds it whole.
MAX_PIXELS = 1 << 28


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[int, int]]:
    """(start, end) of each token but space and comments; a string is one token."""
    while m := _TOKEN.match(data, at):
        start, at = at, m.end()
        first = data[start]
        if first == 0x28:
            depth = 1
            while depth and (p := _PAREN.search(data, at)):
                depth, at = depth + {b"(": 1, b")": -1}.get(p[0], 0), p.end()
            if depth:
                raise ValueError("a string without an end")
        elif first == 0x25 or first <= 0x20:
            continue
        yield start, at


def value_end(data: bytes, at: int) -> int:
    """Where the value that begins at or after `at` ends."""
    depth = 0
    for start, end in tokens(data, at):
        word = data[start:end]
        depth += (word in (b"<<", b"[")) - (word in (b">>", b"]"))
        if depth <= 0:
            return end
    raise ValueError("a value without an end")


def entries(body: bytes) -> dict[str, str]:
    """A dictionary's own entries, values as written; nothing if `body` is no dictionary."""
    found: dict[str, str] = {}
    body = body.strip()
    if not body.startswith(b"<<"):
        return found
    at = 2
    for start, end in tokens(body, at):
        if start < at:
            continue
        if body[start : start + 1] != b"/":
            break
        at = value_end(body, end)
        found[body[start + 1 : end].decode("latin-1")] = body[end:at].strip().decode("latin-1")
    return found


def inflated(entry: dict[str, str], data: bytes) -> bytes | None:
    """A stream's bytes without its codings; None if one of them is an image's, unknown, or broken."""
    try:
        plain, left = filters.undone(entry, data)
    except (zlib.error, ValueError, IndexError):
        return None
    return None if left else plain


def read(data: bytes) -> tuple[dict[str, tuple[bytes, bytes | None]], dict[str, str]]:
    """({key: (value, stream or None)}, trailer) of a file, a key being number_generation."""
    if b"%PDF" not in data[:1024]:
        raise ValueError("no PDF")
    found: dict[str, tuple[bytes, bytes | None]] = {}
    trailer: dict[str, str] = {}
    at = 0
    while m := _OBJECT.search(data, at):
        try:
            end = value_end(data, m.end())
        except ValueError:
            at = m.end()
            continue
        key, body, at = f"{int(m[1])}_{int(m[2])}", data[m.end() : end].strip(), end
        found.pop(key, None)
        found[key] = (body, None)
        mark = re.compile(rb"\s*stream(\r\n|\n|\r)").match(data, end)
        if not mark:
            continue
        size, start = entries(body).get("Length", ""), mark.end()
        ref = _REF.fullmatch(size.encode())
        if size.isdigit() and data[start + int(size) :][:20].lstrip().startswith(b"endstream"):
            at = start + int(size)
            found[key] = (body, data[start:at])
            continue
        if ref and (there := re.compile(rb"(?<![0-9])%d\s+%d\s+obj\s+(\d+)" % (int(ref[1]), int(ref[2]))).search(data)):
            at = start + int(there[1])
            if data[at:][:20].lstrip().startswith(b"endstream"):
                found[key] = (body, data[start:at])
                continue
        at = data.find(b"endstream", start)
        at = len(data) if at < 0 else at
        found[key] = (body, data[start:at].removesuffix(b"\n").removesuffix(b"\r"))
    for m in re.finditer(rb"trailer\s*(?=<<)", data):
        more = entries(data[m.end() : value_end(data, m.end())])
        trailer |= more if "Root" in more else {}
    whole: dict[str, tuple[bytes, bytes | None]] = {}
    for key, (body, stream) in found.items():
        kind = entries(body) if stream is not None else {}
        made = {key: (body, stream)}
        if kind.get("Type") == "/XRef":
            trailer |= {k: v for k, v in kind.items() if k in ("Root", "Info", "ID", "Encrypt")}
            continue
        if kind.get("Type") == "/ObjStm":
            plain = inflated(kind, stream)
            if plain is None:
                raise ValueError("an object stream of another coding")
            first = int(kind["First"])
            numbers = [int(x) for x in plain[:first].split()[: 2 * int(kind["N"])]]
            starts = {f"{n}_0": first + at for n, at in zip(numbers[::2], numbers[1::2], strict=True)}
            made = {k: (plain[at : value_end(plain, at)].strip(), None) for k, at in starts.items()}
        for k, v in made.items():
            whole.pop(k, None)
            whole[k] = v
    if "Encrypt" in trailer:
        raise ValueError("an encrypted PDF")
    if key_of(trailer.get("Root", "")) not in whole:
        raise ValueError("a PDF without a root")
    return whole, trailer


def key_of(ref: str) -> str | None:
    m = _REF.fullmatch(ref.strip().encode("latin-1"))
    return f"{int(m[1])}_{int(m[2])}" if m else None


def references(text: bytes) -> list[str]:
    """Keys that a value refers to, at any depth; what is inside strings is none."""
    return [f"{int(m[1])}_{int(m[2])}" for start, end in _safe_tokens(text) if (m := _REF.fullmatch(text, start, end))]


def _safe_tokens(text: bytes) -> Iterator[tuple[int, int]]:
    """tokens(), up to where the text is broken."""
    try:
        yield from tokens(text)
    except ValueError:
        return


def readdressed(text: str, moves: dict[str, str]) -> str:
    """A value whose references go where `moves` says (key to key); strings and all else stay as written."""
    data, out, at = text.encode("latin-1"), [], 0
    for start, end in _safe_tokens(data):
        m = _REF.fullmatch(data, start, end)
        if m and (now := moves.get(f"{int(m[1])}_{int(m[2])}")):
            out += [data[at:start], now.replace("_", " ").encode(), b" R"]
            at = end
    return b"".join([*out, data[at:]]).decode("latin-1")


def write(found: dict[str, tuple[bytes, bytes | None]], trailer: dict[str, str]) -> bytes:
    """A file of what the trailer's root and information reach; objects without a stream are packed together."""
    reached, stack = set(), [k for k in (key_of(trailer.get(x, "")) for x in ("Root", "Info")) if k in found]
    while stack:
        if (key := stack.pop()) in reached:
            continue
        reached.add(key)
        stack += [k for k in references(found[key][0]) if k in found and k not in reached]
    out = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
    rows: dict[int, tuple[int, int, int]] = {}
    packed: list[tuple[int, bytes]] = []
    for key in sorted(reached, key=lambda k: tuple(map(int, k.split("_")))):
        number, generation = map(int, key.split("_"))
        body, stream = found[key]
        if stream is None and not generation:
            packed.append((number, body))
            continue
        rows[number] = (1, len(out), generation)
        if stream is not None:
            kept = {k: v for k, v in entries(body).items() if k != "Length"} | {"Length": str(len(stream))}
            body = _dictionary(kept) + b"\nstream\n" + stream + b"\nendstream"
        out += b"%d %d obj\n" % (number, generation) + body + b"\nendobj\n"
    top = max((int(k.split("_")[0]) for k in found), default=0) + 1
    for some in range(0, len(packed), PACKED):
        head, body = [], bytearray()
        for j, (number, text) in enumerate(packed[some : some + PACKED]):
            head.append(b"%d %d" % (number, len(body)))
            body += text + b"\n"
            rows[number] = (2, top, j)
        first = b" ".join(head) + b"\n"
        rows[top] = (1, len(out), 0)
        data = zlib.compress(first + bytes(body), 9)
        out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (top, len(head), len(first), len(data)) + data + b"\nendstream\nendobj\n"
        top += 1
    rows[top] = (1, len(out), 0)
    # a file of 4 GB or more needs wider offsets
    wide = 4 if len(out) < 1 << 32 else 8
    free = (0, 0, 0)
    table = b"".join(kind.to_bytes(1) + at.to_bytes(wide) + more.to_bytes(2) for kind, at, more in ((0, 0, 65535) if not n else rows.get(n, free) for n in range(top + 1)))
    data, start = zlib.compress(table, 9), len(out)
    kept = {k: v for k, v in trailer.items() if k in ("Root", "Info", "ID")}
    head = {"Type": "/XRef", "Size": str(top + 1), "W": f"[1 {wide} 2]", "Filter": "/FlateDecode", "Length": str(len(data))} | kept
    return bytes(out + b"%d 0 obj\n" % top + _dictionary(head) + b"\nstream\n" + data + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % start)


def _dictionary(entry: dict[str, str]) -> bytes:
    return ("<< " + " ".join(f"/{k} {v}" for k, v in entry.items()) + " >>").encode("latin-1")


def image_pages(pictures: list[bytes]) -> bytes:
    """One page for each image, as large as the image in points with a long edge of 1600 at most."""
    found: dict[str, tuple[bytes, bytes | None]] = {"1_0": (b"<< /Type /Catalog /Pages 2 0 R >>", None)}
    kids = []
    for k, data in enumerate(pictures):
        px = rasters.on_white(rasters.decode(data))
        h, w = px.shape[:2]
        scale = min(1.0, K.PAGE_MAX_EDGE / max(w, h))
        pw, ph = int(w * scale + 0.5), int(h * scale + 0.5)
        page, image, content = 3 + 3 * k, 4 + 3 * k, 5 + 3 * k
        kids.append(b"%d 0 R" % page)
        found[f"{page}_0"] = (b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /XObject << /Im0 %d 0 R >> >> /Contents %d 0 R >>" % (pw, ph, image, content), None)
        found[f"{image}_0"] = (b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode >>" % (w, h), zlib.compress(px.tobytes(), 9))
        found[f"{content}_0"] = (b"<< >>", b"q %d 0 0 %d 0 0 cm /Im0 Do Q" % (pw, ph))
    found["2_0"] = (b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids)), None)
    return write(found, {"Root": "1 0 R"})


def jpeg_image(width: int, height: int) -> dict[str, str]:
    """The dictionary of an image whose stream is a JPEG."""
    return {"Type": "/XObject", "Subtype": "/Image", "Width": str(width), "Height": str(height), "ColorSpace": "/DeviceRGB", "BitsPerComponent": "8", "Filter": "/DCTDecode"}


def bilevel_image(width: int, height: int) -> dict[str, str]:
    """The dictionary of an image whose stream is Group 4 coded, black being 0."""
    parms = f"<< /K -1 /Columns {width} /Rows {height} /BlackIs1 false /EncodedByteAlign false >>"
    return {"Type": "/XObject", "Subtype": "/Image", "Width": str(width), "Height": str(height), "ColorSpace": "/DeviceGray", "BitsPerComponent": "1", "Filter": "/CCITTFaxDecode", "DecodeParms": parms}


class LeftOut(ValueError):
    """Why an image isn't decoded."""


#: Objects that an image's colour space names, by key: (value, own entries, stream).
Parts = dict[str, tuple[bytes, dict[str, str], bytes | None]]


def _literal(token: bytes) -> bytes:
    """The bytes of a string, in brackets or in hexadecimal."""
    if token.startswith(b"<"):
        return filters.base16(token[1:])
    plain = re.sub(rb"\\\r?\n|\\\r", b"", token[1:-1].replace(b"\r\n", b"\n"))
    escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else escapes.get(m[1], m[1]), plain, flags=re.S)


def _items(array: bytes) -> list[bytes]:
    """The values of an array."""
    found, at = [], 1
    for start, end in tokens(array, 1):
        if start < at:
            continue
        if array[start:end] == b"]":
            break
        at = value_end(array, start)
        found.append(array[start:at])
    return found


#: Colour components of the spaces whose values are colours as they are.
_SPACES = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4}


def colour_space(value: bytes, parts: Parts, depth: int = 0) -> tuple[int, np.ndarray | None]:
    """(components of a colour, or 1 and the palette as (entries, components)) of a colour space, named, given in full
    or referred to."""
    if depth > 4:
        raise LeftOut("a colour space within others")
    key = key_of(value.decode("latin-1"))
    if key:
        if key not in parts:
            raise LeftOut("a colour space that isn't there")
        return colour_space(parts[key][0], parts, depth + 1)
    value = value.strip()
    if value.startswith(b"/"):
        value = b"[" + value + b"]"
    items = _items(value) if value.startswith(b"[") else []
    name = items[0][1:].decode("latin-1") if items else ""
    if name in _SPACES:
        return _SPACES[name], None
    if name == "ICCBased" and len(items) > 1:
        n = parts.get(key_of(items[1].decode("latin-1")) or "", (b"", {}, None))[1].get("N", "")
        if n in ("1", "3", "4"):
            return int(n), None
        raise LeftOut("a profile of unknown components")
    if name in ("Indexed", "I") and len(items) == 4:
        base, inner = colour_space(items[1], parts, depth + 1)
        if inner is not None:
            raise LeftOut("a palette of palette entries")
        ref = key_of(items[3].decode("latin-1"))
        if ref:
            _, entry, stream = parts.get(ref, (b"", {}, None))
            table = inflated(entry, stream) if stream is not None else None
            if table is None:
                raise LeftOut("a palette that can't be read")
        else:
            table = _literal(items[3])
        n = min(255, int(items[2])) + 1
        return 1, np.frombuffer(table.ljust(n * base, b"\0")[: n * base], np.uint8).reshape(n, base)
    raise LeftOut(f"colour space {name or 'none'}")


def _unpacked(data: bytes, w: int, h: int, n: int, depth: int) -> np.ndarray:
    """Samples of 1, 2, 4, 8 or 16 bits, (h, w, n); each row begins with a byte."""
    if depth == 16:
        rows = np.frombuffer(data.ljust(2 * w * h * n, b"\0"), ">u2", w * h * n)
        return rows.reshape(h, w, n).astype(np.int64)
    wide = -(-w * n * depth // 8)
    rows = np.frombuffer(data.ljust(wide * h, b"\0"), np.uint8, wide * h).reshape(h, wide)
    if depth < 8:
        shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
        rows = ((rows[:, :, None] >> shifts) & ((1 << depth) - 1)).reshape(h, -1)
    return rows[:, : w * n].reshape(h, w, n)


def _numbers(text: str) -> list[float]:
    return [float(x) for x in text.strip("[] \t\r\n").split()]


def _coloured(raw: np.ndarray, depth: int, entry: dict[str, str], parts: Parts) -> np.ndarray:
    """RGB of samples of so many bits, by the image's colour space and Decode."""
    n, palette = colour_space(entry.get("ColorSpace", entry.get("CS", {1: "/DeviceGray", 3: "/DeviceRGB", 4: "/DeviceCMYK"}[raw.shape[2]])).encode("latin-1"), parts)
    if raw.shape[2] != n:
        raise LeftOut("samples of another number than the colour space's")
    most = (1 << depth) - 1
    usual = [0.0, float(most)] if palette is not None else [0.0, 1.0] * n
    bounds = _numbers(entry["Decode"]) if "Decode" in entry else _numbers(entry["D"]) if "D" in entry else usual
    if len(bounds) != 2 * n:
        raise LeftOut("a Decode of another length")
    if palette is not None:
        low, high = bounds
        index = raw[..., 0] if bounds == usual else np.round(low + raw[..., 0] * ((high - low) / most))
        px = palette[np.clip(index, 0, len(palette) - 1).astype(np.int64)]
    elif depth == 8 and bounds == usual:
        px = raw.astype(np.uint8)
    else:
        low, high = np.array(bounds[::2]), np.array(bounds[1::2])
        px = np.round(np.clip(low + raw * ((high - low) / most), 0, 1) * 255).astype(np.uint8)
    if px.shape[2] == 4:
        return jpeg.from_inks(px)
    return px if px.shape[2] == 3 else np.repeat(px, 3, axis=2)


def raster(entry: dict[str, str], data: bytes, parts: Parts | None = None) -> np.ndarray:
    """An image stream's pixels, (height, width, 3): JPEG, Group 4, or samples of 1 to 16 bits, gray, RGB, four inks or
    of a palette, behind any of the stream filters. LeftOut tells why an image isn't decoded."""
    try:
        plain, left = filters.undone(entry, data)
        w, h = (int(entry.get(long, entry.get(short, ""))) for long, short in (("Width", "W"), ("Height", "H")))
        depth = int(entry.get("BitsPerComponent", entry.get("BPC", "8")))
        if w < 1 or h < 1 or w * h > MAX_PIXELS:
            raise LeftOut("sides that can't be")
        if not left:
            if depth not in (1, 2, 4, 8, 16):
                raise LeftOut(f"{depth} bits a component")
            n, _ = colour_space(entry.get("ColorSpace", entry.get("CS", "")).encode("latin-1"), parts or {})
            return _coloured(_unpacked(plain, w, h, n, depth), depth, entry, parts or {})
        (name, parms), *more = left
        if more:
            raise LeftOut("filters after an image's own")
        if name == "DCTDecode":
            return _coloured(jpeg.samples(plain)[0], 8, entry, parts or {})
        if name == "CCITTFaxDecode":
            if int(parms.get("K", "0")) >= 0 or parms.get("EncodedByteAlign") == "true":
                raise LeftOut("fax coding other than Group 4")
            ink = g4.decode(plain, int(parms.get("Columns", "1728")), h)[:, :w, None]
            return _coloured(ink if parms.get("BlackIs1") == "true" else 1 - ink, 1, entry, parts or {})
        raise LeftOut(f"filter {name}")
    except LeftOut:
        raise
    except (ValueError, KeyError, IndexError, zlib.error, struct.error) as e:
        raise LeftOut(f"broken: {e}"[:120]) from e


_OPS = {b"q": "save", b"Q": "restore", b"cm": "transform", b"Do": "paint"}


def operators(content: bytes) -> list[tuple[str, list[float] | None, str | None]]:
    """Graphics-state operators of a content stream, in order."""
    found, stack = [], []
    for start, end in tokens(content):
        word = content[start:end]
        if word in _OPS:
            if word == b"cm" and len(stack) >= 6:
                found.append(("transform", [float(x) for x in stack[-6:]], None))
            elif word == b"Do" and stack:
                found.append(("paint", None, stack[-1].decode("latin-1").removeprefix("/")))
            elif word in (b"q", b"Q"):
                found.append((_OPS[word], None, None))
            stack = []
        elif re.fullmatch(rb"[A-Za-z'\"*]+[0-9]?\*?", word):
            stack = []
        else:
            stack.append(word)
    return found


def page_order(found: dict[str, tuple[bytes, bytes | None]], trailer: dict[str, str]) -> list[str]:
    """Keys of the pages as the page tree has them."""
    root = entries(found.get(key_of(trailer.get("Root", "")) or "", (b"", None))[0])
    pages, seen, stack = [], set(), [key_of(root.get("Pages", ""))]
    while stack:
        key = stack.pop()
        if key not in found or key in seen:
            continue
        seen.add(key)
        own = entries(found[key][0])
        if own.get("Type") == "/Page":
            pages.append(key)
            continue
        kids = own.get("Kids", "").encode("latin-1")
        if (ref := key_of(own.get("Kids", ""))) in found:
            kids = found[ref][0]
        stack += reversed(references(kids))
    return pages


def _pages(found: dict[str, tuple[bytes, bytes | None]]) -> Iterator[tuple[str, list]]:
    """(key, operators) of every page; what is painted is told by its key."""
    look = lambda v: found.get(key_of(v) or "", (v.encode("latin-1"), None))
    for key, (body, _) in found.items():
        page = entries(body)
        if page.get("Type") != "/Page":
            continue
        # what a page names comes first, then what those above it name
        names: dict[str, str] = {}
        above, seen = page, {key}
        while True:
            names = entries(look(entries(look(above.get("Resources", ""))[0]).get("XObject", ""))[0]) | names
            up = key_of(above.get("Parent", ""))
            if up not in found or up in seen:
                break
            seen.add(up)
            above = entries(found[up][0])
        content = page.get("Contents", "")
        parts = references(content.encode("latin-1"))
        if len(parts) == 1 and found.get(parts[0], (b"", b""))[1] is None:
            parts = references(found.get(parts[0], (b"", None))[0])
        plain = [inflated(entries(found[p][0]), found[p][1]) for p in parts if p in found and found[p][1] is not None]
        ops = operators(b"\n".join(x for x in plain if x is not None))
        yield key, [(op, m, key_of(names.get(name, "")) if name else None) for op, m, name in ops]


def images_to_pdf(images: DataFrame, job: str, order: str, content: str) -> DataFrame:
    """(job, pdf): the images of each job in order; a job is what one user put together."""
    kind = images.schema[job].dataType.simpleString()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame([(pdf[job].iloc[0], image_pages([bytes(c) for c in pdf[content]]))], columns=[job, "pdf"])

    return images.groupBy(job).applyInPandas(build, f"`{job}` {kind}, pdf binary")


OBJECTS = "path string, key string, ord int, kind string, dict map<string,string>, body string, content binary, refs array<struct<dst:string,entry:string>>, error string"


def objects(files: DataFrame) -> DataFrame:
    """One row for each indirect object of each file (path, content): key, place, kind (dict, stream, other), its own
    entries or, of other values, the value, stream, references; a row `trailer` for each file. A file that can't be
    read is one row with its error."""

    def one(path: str, data: bytes) -> Iterator[tuple]:
        found, trailer = read(data)
        yield path, "trailer", -1, "trailer", trailer, None, None, [{"dst": k, "entry": e} for e in ("Root", "Info") if (k := key_of(trailer.get(e, "")))], None
        for n, (key, (body, stream)) in enumerate(found.items()):
            own = entries(body)
            kind = "stream" if stream is not None else "dict" if body.startswith(b"<<") else "other"
            parts = own.items() if own else [("", body.decode("latin-1"))]
            refs = [{"dst": r, "entry": k} for k, v in parts for r in references(v.encode("latin-1"))]
            yield path, key, n, kind, own, None if kind != "other" else body.decode("latin-1"), stream, refs, None

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in OBJECTS.split(", ")]
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = list(one(path, bytes(data)))
                except (ValueError, KeyError, IndexError) as e:
                    rows = [(path, None, None, None, None, None, None, None, str(e)[:200])]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(take, OBJECTS)


def page_operators(files: DataFrame) -> DataFrame:
    """(path, page, place, ops): the graphics-state operators of every page in order, as operators/docgraph.py replays
    them; place: the page's number in the page tree, from 0, pages that no tree holds last."""
    schema = "path string, page string, place int, ops array<struct<op:string,m:struct<a:double,b:double,c:double,d:double,e:double,f:double>,obj:string>>"

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    found, trailer = read(bytes(data))
                    order = {page: n for n, page in enumerate(page_order(found, trailer))}
                    for page, ops in _pages(found):
                        rows.append((path, page, order.setdefault(page, len(order)), [{"op": op, "m": dict(zip("abcdef", m, strict=True)) if m else None, "obj": obj} for op, m, obj in ops]))
                except (ValueError, KeyError, IndexError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "page", "place", "ops"])

    return files.select("path", "content").mapInPandas(take, schema)
