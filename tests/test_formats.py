"""Stream filters, GIF, progressive JPEG, and images of every kind inside documents."""

import base64
import struct
import zlib

import numpy as np
import pytest

from rasterlake.operators import documents, g4
from rasterlake.sources import filters, gif, jpeg, pdf, rasters
from tests.test_documents import book, smooth, stream


def packed_lzw(codes, low_first):
    """Bits of (code, size) pairs."""
    bits = "".join(format(c, f"0{n}b")[:: -1 if low_first else 1] for c, n in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8][:: -1 if low_first else 1], 2) for k in range(0, len(bits), 8))


def lzw_encoded(data, width=8, low_first=False, early=1, most=4096):
    """A plain coder: the longest known string each time, a fresh table when it is full."""
    clear, stop = 1 << width, (1 << width) + 1
    table, size, codes, at = {bytes([k]): k for k in range(clear)}, width + 1, [], 0
    codes.append((clear, size))
    n, before = stop + 1, None
    while at < len(data):
        end = at + 1
        while end < len(data) and data[at : end + 1] in table:
            end += 1
        codes.append((table[data[at:end]], size))
        if before is not None and n < most:
            n += 1  # what the reader knows by now
        before = data[at:end]
        if end < len(data) and data[at : end + 1] not in table and len(table) + 2 < most:
            table[data[at : end + 1]] = len(table) + 2
        if n + early >= 1 << size and size < 12:
            size += 1
        if n >= most - 2:
            codes.append((clear, size))
            table, size, n, before = {bytes([k]): k for k in range(clear)}, width + 1, stop + 1, None
        at = end
    codes.append((stop, size))
    return packed_lzw(codes, low_first)


@pytest.mark.parametrize("low_first,early", [(False, 1), (False, 0), (True, 0)])
def test_lzw(low_first, early):
    rng = np.random.default_rng(1)
    for width in (2, 3, 7):
        data = bytes(rng.integers(0, 1 << width, 5000, dtype=np.uint8))
        assert filters.lzw(lzw_encoded(data, width, low_first, early), width, low_first, early) == data
    for data in (b"", b"a", b"a" * 500, bytes(rng.integers(0, 4, 9000, dtype=np.uint8)), bytes(rng.integers(0, 256, 30000, dtype=np.uint8))):
        assert filters.lzw(lzw_encoded(data, 8, low_first, early), 8, low_first, early) == data
    with pytest.raises(ValueError):
        filters.lzw(packed_lzw([(256, 9), (300, 9)], False))


def test_small_filters():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 4, 5, 77, 400):
        data = bytes(rng.integers(0, 3, n, dtype=np.uint8))
        assert filters.base85(base64.a85encode(data) + b"~>") == data
        assert filters.base16(data.hex().encode() + b">") == data
        coded = b"".join(bytes([len(p) - 1]) + p for p in (data[k : k + 128] for k in range(0, n, 128))) + b"\x80"
        assert filters.run_lengths(coded) == data
    assert filters.run_lengths(bytes([254, 7, 1, 5, 6, 128, 9])) == b"\7\7\7\5\6"
    rows = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    left = np.diff(rows, axis=1, prepend=np.zeros((2, 1, 3), np.uint8)).astype(np.uint8)
    assert filters.unpredicted(left.tobytes(), {"Predictor": "2", "Columns": "4", "Colors": "3"}) == rows.tobytes()


def test_filter_chains_of_streams():
    data = b"some text of a stream " * 20
    coded = base64.a85encode(lzw_encoded(zlib.compress(data))) + b"~>"
    entry = {"Filter": "[/ASCII85Decode /LZWDecode /Fl]", "DecodeParms": "[null << /EarlyChange 1 >> null]"}
    assert pdf.inflated(entry, coded) == data
    assert pdf.inflated({"Filter": "/RunLengthDecode"}, b"\x02abc\x80") == b"abc"
    assert pdf.inflated({"Filter": "/JBIG2Decode"}, b"x") is None and pdf.inflated({"Filter": "/FlateDecode"}, b"no") is None
    # an object stream behind two filters is read
    inner = b"5 0 << /Type /Catalog /Deep true >>"
    file = b"%PDF-1.5\n7 0 obj\n" + stream(b"/Type /ObjStm /N 1 /First 4 /Filter [/AHx /Fl]", zlib.compress(inner).hex().encode() + b">") + b"\nendobj\ntrailer << /Root 5 0 R >>"
    assert pdf.entries(pdf.read(file)[0]["5_0"][0])["Deep"] == "true"


def jvm_image(spark, px):
    """A picture of the JVM's from (h, w, 3)."""
    h, w = px.shape[:2]
    image = spark._jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, px[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    return image


def jvm_pixels(spark, path):
    image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.File(str(path)))
    w, h = image.getWidth(), image.getHeight()
    if image.getType() == 10:  # gray: the samples themselves, not their colours
        gray = np.array([[image.getRaster().getSample(x, y, 0) for x in range(w)] for y in range(h)])
        return np.stack([gray] * 3 + [np.full_like(gray, 255)], axis=2)
    flat = np.array([[image.getRGB(x, y) & 0xFFFFFFFF for x in range(w)] for y in range(h)], np.int64)
    return np.stack([flat >> 16 & 255, flat >> 8 & 255, flat & 255, flat >> 24 & 255], axis=2)


def jvm_written(spark, px, path, form, progressive=False, quality=0.8, gray=False):
    io = spark._jvm.javax.imageio
    image = jvm_image(spark, px)
    if gray:
        plain = spark._jvm.java.awt.image.BufferedImage(px.shape[1], px.shape[0], 10)
        plain.getGraphics().drawImage(image, 0, 0, None)
        image = plain
    writer = io.ImageIO.getImageWritersByFormatName(form).next()
    given = writer.getDefaultWriteParam()
    if form == "jpeg":
        given.setCompressionMode(2)
        given.setCompressionQuality(float(quality))
    if progressive:
        given.setProgressiveMode(1)
    out = io.ImageIO.createImageOutputStream(spark._jvm.java.io.File(str(path)))
    writer.setOutput(out)
    writer.write(None, io.IIOImage(image, None, None), given)
    out.close()
    writer.dispose()


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("gray", [False, True])
def test_jpeg_as_the_jvm_reads_it(spark, tmp_path, progressive, gray):
    """Streams that another coder wrote: both readers see the same, but for how coarse chroma is spread."""
    for k, (h, w, quality) in enumerate(((16, 16, 0.9), (45, 61, 0.75), (8, 70, 0.3))):
        px = smooth(h, w, k)
        path = tmp_path / f"{k}.jpg"
        jvm_written(spark, px, path, "jpeg", progressive, quality, gray)
        data = path.read_bytes()
        assert (b"\xff\xc2" in data) == progressive
        seen, mine = jvm_pixels(spark, path)[..., :3], jpeg.decode(data).astype(int)
        assert mine.shape == seen.shape
        if gray:
            assert np.abs(mine - seen).max() <= 1
        else:
            assert np.abs(rasters.luma(mine.astype(np.uint8)) - rasters.luma(seen.astype(np.uint8))).mean() < 2.5


def test_progressive_scans_hold_the_same_coefficients(spark, tmp_path):
    """Approximation by bits and by bands: what the JVM's progressive writer makes of a picture has the coefficients
    that its baseline writer makes of it."""
    for k, (h, w) in enumerate(((40, 56), (17, 9), (64, 33))):
        px = smooth(h, w, 10 + k)
        for progressive in (False, True):
            jvm_written(spark, px, tmp_path / f"{progressive}.jpg", "jpeg", progressive, 0.85)
        (a, *_), (b, *_) = (jpeg._read((tmp_path / f"{p}.jpg").read_bytes()) for p in (False, True))
        for x, y in zip(a, b, strict=True):
            mx, my = max(p["x"] for p in a), max(p["y"] for p in a)
            wide, high = -(-(-(-w * x["x"] // mx)) // 8), -(-(-(-h * x["y"] // my)) // 8)
            x, y = (np.array(p["values"]).reshape(p["high"], p["wide"], 64)[:high, :wide] for p in (x, y))
            assert (x == y).all()


def test_jpeg_of_four_inks():
    ink = np.zeros((8, 8, 4), np.uint8)
    ink[..., 0], ink[..., 3] = 200, 100
    assert (jpeg.from_inks(ink)[0, 0] == [0, 155, 155]).all()


def gif_file(frames, w, h, palette, lace=False):
    """frames: (x, y, index, disposal, transparent)."""
    bits = max(1, (len(palette) - 1).bit_length())
    table = palette.astype(np.uint8).tobytes().ljust(3 << bits, b"\0")
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | bits - 1, 0, 0) + table
    for x, y, index, disposal, clear in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 0, clear or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", x, y, index.shape[1], index.shape[0], 0x40 if lace else 0)
        rows = index[gif._rows(len(index))] if lace else index
        width = max(2, bits)
        coded = lzw_encoded(rows.astype(np.uint8).tobytes(), width, True, 0)
        out += bytes([width]) + b"".join(bytes([len(p)]) + p for p in (coded[k : k + 255] for k in range(0, len(coded), 255))) + b"\0"
    return out + b"\x3b"


@pytest.mark.parametrize("lace", [False, True])
def test_gif_as_the_jvm_reads_it(spark, tmp_path, lace):
    rng = np.random.default_rng(3)
    for k, (h, w, colours) in enumerate(((1, 1, 2), (13, 22, 3), (50, 70, 256))):
        palette = rng.integers(0, 256, (colours, 3))
        index = rng.integers(0, colours, (h, w))
        path = tmp_path / f"{k}.gif"
        path.write_bytes(gif_file([(0, 0, index, 0, 1)], w, h, palette, lace))
        mine, seen = gif.decode(path.read_bytes()), jvm_pixels(spark, path)
        assert (mine[..., 3] == seen[..., 3]).all() and (mine[..., :3] == seen[..., :3])[mine[..., 3] > 0].all()
        assert (mine[..., :3][index != 1] == palette[index[index != 1]]).all()
    written = tmp_path / "jvm.gif"
    px = np.repeat(np.repeat(rng.integers(0, 2, (6, 8, 3)) * 255, 5, axis=0), 5, axis=1).astype(np.uint8)
    jvm_written(spark, px, written, "gif")
    assert (rasters.decode(written.read_bytes()) == px).all()


def test_gif_frames():
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [9, 9, 9]])
    full = np.full((4, 4), 1)
    small = np.array([[2, 3], [3, 2]])
    data = gif_file([(0, 0, full, 0, None), (1, 1, small, 2, 3), (2, 2, small, 3, None), (0, 0, np.full((1, 1), 2), 0, None)], 4, 4, palette)
    first, second, third, fourth = gif.pictures(data)
    assert gif.frames(data) == 4 and (first[..., 0] == 255).all()
    assert second[1, 1].tolist() == [0, 255, 0, 255] and second[1, 2].tolist() == [255, 0, 0, 255]
    assert third[1, 1].tolist() == [0, 0, 0, 0] and third[2, 2].tolist() == [0, 255, 0, 255]
    assert fourth[2, 2].tolist() == [0, 0, 0, 0] and fourth[0, 0].tolist() == [0, 255, 0, 255] and fourth[3, 3].tolist() == [255, 0, 0, 255]
    for bad in (b"", b"GIF89a", data[:20], data[:-30].replace(b"GIF89a", b"GIF80a")):
        with pytest.raises((ValueError, struct.error)):
            gif.decode(bad)
    with pytest.raises(ValueError):
        gif.decode(data, 4)


# images inside documents ---------------------------------------------------------------------------------------


def bits_of(index, depth):
    """Rows of samples packed to bytes."""
    h = len(index)
    planes = (index.reshape(h, -1)[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1
    return np.packbits(planes.reshape(h, -1).astype(np.uint8), axis=1).tobytes()


def entry_of(px, space, depth, more=""):
    return pdf.entries(b"<< /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent %d %s >>" % (px.shape[1], px.shape[0], space, depth, more.encode()))


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
def test_rasters_of_every_depth(depth):
    rng = np.random.default_rng(depth)
    most = (1 << depth) - 1
    gray = rng.integers(0, most + 1, (7, 13))
    data = gray.astype(">u2").tobytes() if depth == 16 else bits_of(gray, depth)
    want = np.round(gray / most * 255).astype(np.uint8)
    assert (pdf.raster(entry_of(gray, b"/DeviceGray", depth), data)[..., 1] == want).all()
    assert (pdf.raster(entry_of(gray, b"/DeviceGray", depth, "/Decode [1 0] /Filter /FlateDecode"), zlib.compress(data))[..., 0] == np.round((most - gray) / most * 255)).all()
    rgb = rng.integers(0, most + 1, (5, 6, 3))
    data = rgb.astype(">u2").tobytes() if depth == 16 else bits_of(rgb, depth)
    assert (pdf.raster(entry_of(rgb, b"[/CalRGB << /WhitePoint [1 1 1] >>]", depth), data) == np.round(rgb / most * 255)).all()
    if depth <= 8:
        palette = rng.integers(0, 256, (most + 1, 3), dtype=np.uint8)
        parts = {"5_0": (b"[/Indexed 6 0 R %d 7 0 R]" % most, {}, None), "6_0": (b"[/ICCBased 8 0 R]", {}, None), "7_0": (b"", {"Filter": "/FlateDecode"}, zlib.compress(palette.tobytes())), "8_0": (b"", {"N": "3"}, None)}
        for space in (b"5 0 R", b"[/Indexed /DeviceRGB %d <%s>]" % (most, palette.tobytes().hex().encode())):
            assert (pdf.raster(entry_of(gray, space, depth), bits_of(gray, depth), parts) == palette[gray]).all()


def test_rasters_of_other_codings():
    rng = np.random.default_rng(9)
    ink = (rng.random((20, 33)) < 0.3).astype(np.uint8)
    code = g4.encode(ink)
    fax = "/Filter [/CCITTFaxDecode] /DecodeParms [<< /K -1 /Columns 33 /Rows 20 %s >>]"
    assert (pdf.raster(entry_of(ink, b"/DeviceGray", 1, fax % ""), code)[..., 0] == 255 * (1 - ink)).all()
    assert (pdf.raster(entry_of(ink, b"/DeviceGray", 1, fax % "/BlackIs1 true"), code)[..., 0] == 255 * ink).all()
    assert (pdf.raster(entry_of(ink, b"[/Indexed /DeviceRGB 1 (\\000\\n\\)abc)]", 1, fax % ""), code)[0, 0] == [[97, 98, 99], [0, 10, 41]][int(ink[0, 0])]).all()
    cmyk = rng.integers(0, 256, (6, 5, 4), dtype=np.uint8)
    made = pdf.raster(entry_of(cmyk, b"/DeviceCMYK", 8), cmyk.tobytes()).astype(int)
    assert (made == 255 - np.minimum(255, cmyk[..., :3].astype(int) + cmyk[..., 3:])).all()
    px = smooth(24, 40)
    data, back = jpeg.encode(px, 0.9)
    assert (pdf.raster(entry_of(px, b"/DeviceRGB", 8, "/Filter /DCTDecode"), data) == back).all()
    assert (pdf.raster(entry_of(px, b"/DeviceRGB", 8, "/Filter /DCTDecode /Decode [1 0 1 0 1 0]"), data) == 255 - back).all()
    gray = np.full((16, 16), 77, np.uint8)
    assert (pdf.raster(entry_of(gray, b"/DeviceGray", 8, "/Filter [/ASCII85Decode /LZWDecode]"), base64.a85encode(lzw_encoded(gray.tobytes())) + b"~>") == 77).all()


@pytest.mark.parametrize("space,depth,more,why", [(b"/Pattern", 8, "", "colour space Pattern"), (b"[/Separation /X /DeviceCMYK 9 0 R]", 8, "", "Separation"), (b"/DeviceRGB", 3, "", "3 bits"), (b"/DeviceRGB", 8, "/Filter /JPXDecode", "filter JPXDecode"), (b"/DeviceRGB", 8, "/Filter /JBIG2Decode", "JBIG2Decode"), (b"12 0 R", 8, "", "isn't there"), (b"/DeviceRGB", 8, "/Decode [0 1]", "Decode"), (b"/DeviceGray", 1, "/Filter /CCITTFaxDecode /DecodeParms << /K 0 >>", "Group 4"), (b"/DeviceRGB", 8, "/Filter /DCTDecode", "broken"), (b"[/ICCBased 3 0 R]", 8, "", "profile")])
def test_images_left_out_say_why(space, depth, more, why):
    with pytest.raises(pdf.LeftOut, match=why):
        pdf.raster(entry_of(np.zeros((4, 4)), space, depth, more), b"\0" * 64)


def picture_file(images, extra=()):
    """One page that paints each image (number, dictionary, data)."""
    names = b" ".join(b"/I%d %d 0 R" % (n, n) for n, *_ in images)
    paint = b" ".join(b"q 300 0 0 200 0 0 cm /I%d Do Q" % n for n, *_ in images)
    objects = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), (3, b"<< /Type /Page /Parent 2 0 R /Resources << /XObject << " + names + b" >> >> /Contents 4 0 R >>"), (4, stream(b"", paint))]
    return book(objects + [(n, stream(head, data)) for n, head, data in images] + list(extra), "/Root 1 0 R")


def image_head(px, space, more=b""):
    return b"/Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace " % (px.shape[1], px.shape[0]) + space + b" " + more


def test_documents_with_images_of_every_kind(spark):
    px, rng = smooth(80, 120), np.random.default_rng(4)
    index, palette = rng.integers(0, 16, (80, 120), dtype=np.uint8), rng.integers(0, 256, (16, 3), dtype=np.uint8)
    cmyk = np.concatenate([255 - px, np.zeros((80, 120, 1), np.uint8)], axis=2)
    images = [
        (10, image_head(px, b"[/ICCBased 20 0 R]"), px.tobytes()),
        (11, image_head(index, b"21 0 R"), index.tobytes()),
        (12, image_head(px, b"/DeviceCMYK"), cmyk.tobytes()),
        (13, image_head(px, b"[/Separation /Spot /DeviceCMYK 23 0 R]"), px[..., 0].tobytes()),
        (14, image_head(px, b"/DeviceRGB", b"/Filter /JPXDecode"), b"x" * 3000),
        (15, image_head(px, b"/DeviceRGB", b"/Filter /DCTDecode /Decode [1 0 1 0 1 0]"), jpeg.encode(px, 1.0)[0]),
    ]
    extra = [(20, stream(b"/N 3 /Alternate /DeviceRGB", b"profile" * 100)), (21, b"[/Indexed 22 0 R 15 24 0 R]"), (22, b"[/ICCBased 20 0 R]"), (23, b"<< /FunctionType 2 >>"), (24, stream(b"", palette.tobytes()))]
    table = spark.createDataFrame([("a", bytearray(picture_file(images, extra)))], "path string, content binary")
    r = documents.compress_documents(table, max_dpi=150).first()
    assert (r.status, r.images, r.left_out, r.technique) == ("done", 4, 2, "pdf-images")
    assert [(x.key, x.why) for x in r.left_out_images] == [("13_0", "colour space Separation"), ("14_0", "filter JPXDecode")]
    found, _ = pdf.read(bytes(r.content))
    for key, want in (("10_0", px), ("11_0", palette[index]), ("12_0", px), ("15_0", 255 - px)):
        body, data = found[key]
        made = pdf.raster(pdf.entries(body), data)
        assert pdf.entries(body)["Filter"] == "/DCTDecode" and np.abs(made.astype(int) - want).mean() < (60 if key == "11_0" else 8)
    assert found["14_0"][1] == b"x" * 3000 and b"JPXDecode" in found["14_0"][0]


def test_wide_images_keep_their_sides(spark):
    """A width that looks like anything: 4712 by 300, 4711 by 47, both codings."""
    rng = np.random.default_rng(5)
    ink = np.repeat(np.repeat((rng.random((30, 472)) > 0.02) * 255, 10, axis=0), 10, axis=1)[:300, :4712].astype(np.uint8)
    px = smooth(47, 4711)
    images = [(10, image_head(ink, b"/DeviceGray"), ink.tobytes()), (11, image_head(px, b"/DeviceRGB"), px.tobytes())]
    table = spark.createDataFrame([("a", bytearray(picture_file(images)))], "path string, content binary")
    r = documents.compress_documents(table, max_dpi=10_000).first()
    found, _ = pdf.read(bytes(r.content))
    scan, photo = (pdf.entries(found[k][0]) for k in ("10_0", "11_0"))
    assert (scan["Width"], scan["Height"], photo["Width"], photo["Height"]) == ("4712", "300", "4711", "47")
    assert pdf.entries(scan["DecodeParms"].encode())["Columns"] == "4712" and pdf.entries(scan["DecodeParms"].encode())["Rows"] == "300"
    assert (pdf.raster(scan, found["10_0"][1])[..., 0] == ink).all()


def test_many_objects_are_written_and_read():
    n = 70_000
    found = {f"{k}_0": (b"<< /Next %d 0 R /Text (%d 0 R) >>" % (k + 1, k), None) for k in range(1, n)} | {f"{n}_0": (b"[1 2 3]", None)}
    data = pdf.write(found, {"Root": "1 0 R"})
    assert data.count(b"/ObjStm") == n // pdf.PACKED
    again, _ = pdf.read(data)
    assert again == found


def test_files_that_cannot_be_written_are_told(spark, monkeypatch):
    px = smooth(40, 60)
    good = picture_file([(10, image_head(px, b"/DeviceRGB"), px.tobytes())])
    bad = picture_file([(10, image_head(px, b"/DeviceRGB"), px.tobytes())], [(2**40, b"<< /Far true >>")]).replace(b"/Count 1", b"/Count 1 /X %d 0 R" % 2**40)
    table = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(bad)), ("none", bytearray(b"%PDF")), ("null", None)], "path string, content binary")
    got = {r.path: r for r in documents.compress_documents(table.where("path <> 'null'")).collect()}
    assert got["good"].status == "done" and got["good"].technique == "pdf-images"
    assert got["bad"].status.startswith("error: ") and bytes(got["bad"].content) == bad and got["bad"].technique == "untouched"
    assert got["none"].status.startswith("error: ")


def test_text_that_looks_like_a_reference_stays(spark):
    px = smooth(40, 60)
    raw = zlib.compress(px.tobytes())
    images = [(n, image_head(px, b"/DeviceRGB", b"/Filter /FlateDecode"), raw) for n in (12, 13)]
    file = picture_file(images, [(30, b"[13 0 R (13 0 R) << /A [ 13\n0 R 113 0 R ] /B (a \\) 13 0 R) >> <31332030> ]")]).replace(b"/Pages 2 0 R", b"/Pages 2 0 R /Title (13 0 R) /More 30 0 R")
    r = documents.compress_documents(spark.createDataFrame([("a", bytearray(file))], "path string, content binary")).first()
    found, _ = pdf.read(bytes(r.content))
    assert r.merged_images == 1 and "13_0" not in found
    assert pdf.entries(found["1_0"][0])["Title"] == "(13 0 R)"
    assert found["30_0"][0] == b"[12 0 R (13 0 R) << /A [ 12 0 R 113 0 R ] /B (a \\) 13 0 R) >> <31332030> ]"
    assert pdf.readdressed("(1 0 R) 1 0 R % 1 0 R\n11 0 R", {"1_0": "7_0"}) == "(1 0 R) 7 0 R % 1 0 R\n11 0 R"


# size targets over rows ----------------------------------------------------------------------------------------


def test_search_finds_what_bisection_of_each_file_finds(spark):
    from pyspark.sql import functions as F

    rooms = [(f"f{k}", 1, float(k * k * 13)) for k in range(40)]
    state = spark.createDataFrame(rooms, "path string, shares int, room double")
    size = lambda s, q: int(9000 * s * s * q + 300 * q)
    asked = []

    def probe(values):
        asked.append(values.count())
        return values.select("path", F.floor(9000 * F.col("scale") * F.col("scale") * F.col("quality") + 300 * F.col("quality")).alias("size"))

    got = {r.path: (r.scale, r.quality) for r in documents.searched(probe, state).collect()}
    for path, _, room in rooms:
        scale, quality = documents.largest_fit(lambda v: size(v, 0.82), 0.05, 1.0, 8, room), 0.82
        if scale is None:
            scale, quality = 0.05, documents.largest_fit(lambda v: size(0.05, v), 0.3, 0.82, 6, room) or 0.3
        assert got[path] == (pytest.approx(scale), pytest.approx(quality))
    assert len(asked) <= 17


def test_a_document_of_many_images_is_fitted_over_many_tasks(spark):
    images = []
    for k in range(500):
        px = smooth(24, 32, k % 7)
        px[0, 0] = [k % 256, k // 256, 7]
        images.append((10 + k, image_head(px, b"/DeviceRGB"), px.tobytes()))
    few = images[:3]
    files = [("many", bytearray(picture_file(images))), ("few", bytearray(picture_file(few))), ("fits", bytearray(picture_file(few[:1])))]
    table = spark.createDataFrame(files, "path string, content binary")
    target = 5000
    got = {r.path: r for r in documents.compress_documents(table, target_bytes=target).collect()}
    assert got["few"].hit_target and got["few"].new_bytes <= target and got["fits"].technique == "untouched" and got["fits"].hit_target
    assert got["many"].images == 500 and not got["many"].hit_target
    rows = pdf.objects(table.where("path = 'many'"))
    placed = rows.where("kind = 'stream' and dict['Subtype'] = '/Image'").selectExpr("*", "cast(null as double) width_pt", "cast(null as double) height_pt", "cast(null as map<string,struct<body:string,dict:map<string,string>,content:binary>>) parts")
    rasters_ = documents.decoded_images(placed, 300)
    shares = {r.salt for r in rasters_.select("salt").distinct().collect()}
    assert len(shares) == 63 and rasters_.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert min(rasters_.rdd.glom().map(len).collect()) > 50


# PNG -----------------------------------------------------------------------------------------------------------


def png_samples():
    rng = np.random.default_rng(8)
    noise = rng.integers(0, 256, (30, 40, 3), dtype=np.uint8)
    gray = np.repeat(rng.integers(0, 256, (21, 33, 1), dtype=np.uint8), 3, axis=2)
    few = rng.integers(0, 256, (7, 3), dtype=np.uint8)[rng.integers(0, 7, (40, 31))]
    alpha = np.concatenate([few, rng.choice(np.array([0, 128, 255], np.uint8), (40, 31, 1))], axis=2)
    return {
        "noise": noise, "smooth": smooth(48, 64), "gray": gray, "few": few, "alpha": alpha, "opaque alpha": np.concatenate([few, np.full((40, 31, 1), 255, np.uint8)], axis=2),
        "bilevel": np.repeat(rng.choice(np.array([0, 255], np.uint8), (19, 23, 1)), 3, axis=2), "four grays": np.repeat(rng.choice(np.array([0, 85, 170, 255], np.uint8), (19, 23, 1)), 3, axis=2),
        "sixteen grays": np.repeat(17 * rng.integers(0, 16, (19, 23, 1), dtype=np.uint8), 3, axis=2), "one": np.full((1, 1, 3), 9, np.uint8), "row": noise[:1], "column": noise[:, :1], "flat": np.full((50, 50, 3), 200, np.uint8),
        "noise and alpha": rng.integers(0, 256, (20, 20, 4), dtype=np.uint8), "gray and alpha": np.concatenate([gray, rng.integers(0, 256, (21, 33, 1), dtype=np.uint8)], axis=2),
    }


@pytest.mark.parametrize("name", list(png_samples()))
def test_optimised_png(spark, tmp_path, name):
    px = png_samples()[name]
    best, steps = rasters.optimised_png(px)
    assert [s.split(":")[0] for s, _ in steps] == ["quick", "form", "filters", "compressor"]
    assert steps[0][1] == len(rasters.encode_png(px)) and steps[-1][1] == len(best) and [n for _, n in steps] == sorted((n for _, n in steps), reverse=True)
    back = rasters.decode_png(best)
    same = px if px.shape[2] == 3 or (px[..., 3] < 255).any() else px[..., :3]
    if back.shape[2] == 3 and same.shape[2] == 4:
        same = same[..., :3]
    assert (back == same).all()
    (tmp_path / "a.png").write_bytes(best)
    seen = jvm_pixels(spark, tmp_path / "a.png") if (back[..., 0] != back[..., 1]).any() else None  # of gray it makes colours
    assert seen is None or (seen[..., : same.shape[2]] == same).all()


def test_png_forms_are_reduced():
    want = {"gray": ("gray", 8), "bilevel": ("gray", 1), "four grays": ("gray", 2), "sixteen grays": ("gray", 4)}
    for name, (form, bits) in want.items():
        assert (form, bits) in [(f[0], f[2]) for f in rasters.forms(png_samples()[name])]
    assert [(f[0], f[2]) for f in rasters.forms(png_samples()["few"])] == [("colour", 8), ("palette", 4)]
    assert [f[0] for f in rasters.forms(png_samples()["opaque alpha"])] == ["colour and alpha", "colour", "palette"]


@pytest.mark.parametrize("seed", range(12))
def test_optimised_png_is_lossless_and_not_larger(seed):
    rng = np.random.default_rng(seed)
    h, w, n = rng.integers(1, 40), rng.integers(1, 40), rng.choice([3, 4])
    palette = rng.integers(0, 256, (rng.choice([2, 5, 200, 4000]), n), dtype=np.uint8)
    px = palette[rng.integers(0, len(palette), (h, w))]
    best, steps = rasters.optimised_png(px)
    back = rasters.decode_png(best)
    assert (back[..., :3] == px[..., :3]).all() and len(best) <= len(rasters.encode_png(px)) == steps[0][1]
    assert n == 3 or (back[..., 3] == px[..., 3]).all() if back.shape[2] == 4 else n == 3 or (px[..., 3] == 255).all()
    out, chosen, index = rasters.quantize(px, 16)
    if n == 3:
        small = rasters.optimised_png(out, chosen, index)[0]
        assert (rasters.decode_png(small) == out).all() and len(small) <= len(rasters.encode_png(out, chosen, index))


def laced(px):
    h, w = px.shape[:2]
    body = b"".join(np.pad(part.reshape(len(part), -1), ((0, 0), (1, 0))).tobytes() for part in (px[y::dy, x::dx] for x, y, dx, dy in rasters._passes(w, h, True)))
    return rasters._SIGNATURE + rasters._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 1)) + rasters._chunk(b"IDAT", zlib.compress(body)) + rasters._chunk(b"IEND", b"")


def test_png_of_other_kinds():
    px = smooth(13, 11)
    for part in (px, px[:1], px[:, :1], px[:5, :3]):
        assert (rasters.decode_png(laced(part)) == part).all()
    deep = np.random.default_rng(1).integers(0, 65536, (4, 5, 3))
    rows = np.concatenate([np.zeros((4, 1), np.uint8), deep.astype(">u2").view(np.uint8).reshape(4, -1)], axis=1)
    head = lambda kind, depth, w, h: rasters._SIGNATURE + rasters._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0))
    end = rasters._chunk(b"IEND", b"")
    assert (rasters.decode_png(head(2, 16, 5, 4) + rasters._chunk(b"IDAT", zlib.compress(rows.tobytes())) + end) == deep >> 8).all()
    gray = head(0, 2, 4, 1) + rasters._chunk(b"tRNS", b"\0\2") + rasters._chunk(b"IDAT", zlib.compress(bytes([0, 0b00011011]))) + end
    assert rasters.decode_png(gray)[0].tolist() == [[0, 0, 0, 255], [85, 85, 85, 255], [170, 170, 170, 0], [255, 255, 255, 255]]
    with pytest.raises(ValueError):
        rasters.decode_png(head(7, 8, 1, 1) + end)


def test_images_are_optimised_and_told_by_step(spark):
    from rasterlake.operators import images

    px = png_samples()["few"]
    table = spark.createDataFrame([("a", bytearray(rasters.encode_bmp(px))), ("b", bytearray(rasters.optimised_png(px)[0])), ("c", bytearray(b"no")), ("d", None)], "path string, content binary")
    got = {r.path: r for r in images.optimise_images(table).collect()}
    assert got["a"].new_bytes == got["b"].new_bytes == got["b"].original_bytes and len(got["a"].steps) == 4
    assert (rasters.decode(bytes(got["a"].content)) == px).all() and got["c"].status.startswith("error") and got["d"].status.startswith("error")
    made = {q: images.convert_images(table.where("path = 'a'"), "jpeg", q).first().content for q in (0.2, 0.95)}
    assert len(made[0.2]) < len(made[0.95])


def test_plans_of_tables_and_of_pictures_agree(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = [(k, int(rng.integers(1, 900)), int(rng.integers(1, 900)), *(float(x) if rng.random() < 0.8 else None for x in rng.uniform(0, 400, 2))) for k in range(150)]
    table = spark.createDataFrame(rows, "k int, w long, h long, wp double, hp double")
    for dpi in (72.0, 150.0, 300.0):
        w, h, smaller = documents.plan(*map(F.col, ("w", "h", "wp", "hp")), dpi)
        got = {r.k: (r.bw, r.bh, r.less) for r in table.select("k", w.alias("bw"), h.alias("bh"), smaller.alias("less")).collect()}
        for k, w, h, wp, hp in rows:
            p = documents.Picture.planned(np.zeros((h, w, 3), np.uint8), wp, hp, dpi)
            assert got[k] == (p.w, p.h, p.w < w or p.h < h)
