"""JPEG coding, PDF files and the compression of documents and photos."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake import constants as K
from rasterlake.operators import budget, docgraph, documents, g4, images
from rasterlake.sources import files, jpeg, pdf, rasters


def smooth(h, w, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    waves = [np.sin(x / rng.uniform(5, 40) + rng.uniform(0, 6)) * np.cos(y / rng.uniform(5, 40)) for _ in range(3)]
    return np.clip(128 + 90 * np.stack(waves, axis=2) + rng.normal(0, 2, (h, w, 3)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("h,w", [(64, 64), (37, 53), (1, 1), (16, 200)])
@pytest.mark.parametrize("quality", [0.1, 0.5, 0.88, 1.0])
def test_jpeg_round_trip(h, w, quality):
    px = smooth(h, w)
    data, back = jpeg.encode(px, quality)
    assert (jpeg.decode(data) == back).all() and back.shape == px.shape
    if quality >= 0.88:
        assert np.abs(back.astype(int) - px).mean() < 12


def test_jpeg_extremes():
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 2, (80, 80, 3), dtype=np.uint8) * 255
    for px in (noise, np.zeros((9, 9, 3), np.uint8), np.full((40, 8, 3), 255, np.uint8)):
        data, back = jpeg.encode(px, 1.0)
        assert (jpeg.decode(data) == back).all()
    sizes = [len(jpeg.encode(smooth(64, 64), q)[0]) for q in (0.1, 0.3, 0.5, 0.7, 0.9)]
    assert sizes == sorted(sizes)
    for bad in (b"", b"\xff\xd8", jpeg.encode(noise, 0.5)[0].replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            jpeg.decode(bad)


def test_huffman_codes_are_optimal_within_their_bound():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 200):
        counts = np.zeros(256, np.int64)
        counts[rng.permutation(256)[:n]] = (1.6 ** rng.integers(0, 30, n)).astype(np.int64)
        lengths = jpeg.huffman_lengths(counts)
        used = lengths[lengths > 0]
        assert len(used) == n + 1 and used.max() <= 16 and sum(2.0**-used) == 1


def test_jpeg_is_read_elsewhere(spark, tmp_path):
    """The JVM's decoder sees the same picture; chroma may be interpolated differently."""
    px = smooth(60, 90)
    data, back = jpeg.encode(px, 0.9)
    (tmp_path / "a.jpg").write_bytes(data)
    r = files.decode_images(spark, str(tmp_path / "a.jpg")).first()
    seen = np.frombuffer(r.bgr, np.uint8).reshape(60, 90, 3)[..., ::-1]
    assert np.abs(seen.astype(int) - back).mean() < 4


def test_photos_by_similarity_and_by_size(spark):
    px = smooth(180, 240)
    png = rasters.encode_png(px)
    table = spark.createDataFrame([("a.png", bytearray(png)), ("b.jpg", bytearray(jpeg.encode(px, 0.97)[0]))], "path string, content binary")
    for floor in (0.99, 0.965):
        made = {r.path: r for r in images.compress_images(table, floor).collect()}
        r = made["a.png"]
        assert r.technique == "ssim-search" and r.ssim >= floor and r.format_label == "JPG" and r.new_bytes < len(png) / 2
        assert rasters.Reference(px).score(jpeg.decode(bytes(r.content))) == pytest.approx(r.ssim)
    for target in (12000, 3000, 900, 10):
        made = {r.path: r for r in images.compress_images(table, target_bytes=target).collect()}
        assert all(r.hit_target == (r.new_bytes <= target) for r in made.values())
        assert made["a.png"].hit_target == (target > 100) or target == 900
    same = images.compress_images(table, target_bytes=10**6, fmt="jpeg").collect()
    assert {r.path: r.technique for r in same} == {"a.png": "lossy-resample", "b.jpg": "untouched"}
    assert {r.status for r in images.compress_images(table, fmt="webp").collect()} == {"unsupported"}
    again = {r.path: r for r in images.convert_images(table, "jpeg").collect()}
    assert jpeg.decode(bytes(again["a.png"].content)).shape == px.shape


def test_largest_fit():
    for k in range(200):
        f = lambda v: v * v * 1.9
        got = documents.largest_fit(f, 0.15, 1.0, 6, k / 100)
        fits = [v for v in (0.15 + j * 0.85 / 64 for j in range(64)) if f(v) <= k / 100]
        assert got == (pytest.approx(max(fits)) if fits else None)


def book(objects, trailer="/Root 1 0 R /Info 9 0 R", eol=b"\n"):
    """A file as older writers make it: every object by itself, a plain trailer."""
    out = bytearray(b"%PDF-1.4" + eol)
    for n, body in objects:
        out += b"%d 0 obj" % n + eol + body + eol + b"endobj" + eol
    return bytes(out + b"trailer" + eol + b"<< /Size 99 " + trailer.encode() + b" >>" + eol)


def stream(head, data):
    return b"<< " + head + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"


def sample(px, scan, font=b"f" * 500):
    image = lambda data: stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode" % (px.shape[1], px.shape[0]), data)
    gray = stream(b"/Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8" % (scan.shape[1], scan.shape[0]), scan.tobytes())
    raw = zlib.compress(px.tobytes())
    content = stream(b"/Filter /FlateDecode", zlib.compress(b"q 300 0 0 200 0 0 cm/Im0 Do Q q 2 0 0 2 0 0 cm 50 0 0 30 0 0 cm /Im1 Do Q (a \\) string / Do) Tj"))
    return [
        (1, b"<< /Type /Catalog /Pages 2 0 R /Metadata 8 0 R >>"),
        (2, b"<< /Type /Pages /Kids [3 0 R 12 0 R] /Count 2 /Resources << /XObject << /Im0 4 0 R /Im1 5 0 R /Im2 7 0 R >> >> >>"),
        (3, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 600 400] /Contents [6 0 R] /Thumb 8 0 R >>"),
        (4, image(raw)), (5, image(raw)), (6, content), (7, gray),
        (8, stream(b"/Type /Metadata", b"endobj 3 0 obj << /no >> x" * 60)),
        (9, b"<< /Title (A \\(b\\)) /Author (x) >>"),
        (10, stream(b"/Length1 500", font)), (11, stream(b"/Length1 500", font)),
        (12, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 600 400] /Contents 14 0 R /F [<< /A 13 0 R >> [<< /FontFile2 10 0 R /B << /FontFile2 11 0 R >> >>]] >>"),
        (13, b"<< /Type /FontDescriptor /FontFile2 11 0 R >>"), (14, stream(b"", b"q 600 0 0 400 0 0 cm /Im2 Do Q")), (20, b"<< /Type /FontDescriptor /FontFile2 10 0 R >>"),
    ]


def test_pdf_is_read_and_written():
    px, scan = smooth(40, 60), np.zeros((60, 60), np.uint8)
    for eol in (b"\n", b"\r\n"):
        found, trailer = pdf.read(book(sample(px, scan), eol=eol))
        assert len(found) == 15 and found["8_0"][1] == b"endobj 3 0 obj << /no >> x" * 60
        again, said = pdf.read(pdf.write(found, trailer))
        assert set(again) == set(found) - {"20_0"} and said["Root"] == "1 0 R"
        for key, (body, data) in again.items():
            assert data == found[key][1] and pdf.entries(body) == pdf.entries(found[key][0])
    # a later definition counts, whether in an object stream or not
    newer = pdf.write({"1_0": (b"<< /Type /Catalog /New true >>", None)}, {"Root": "1 0 R"})
    assert pdf.entries(pdf.read(book(sample(px, scan)) + newer)[0]["1_0"][0])["New"] == "true"
    assert pdf.entries(pdf.read(newer + book(sample(px, scan)))[0]["1_0"][0])["Pages"] == "2 0 R"
    for bad in (b"", b"%PDF-1.4", book([(1, b"<< /Type /Catalog >>")], "/Root 1 0 R /Encrypt 2 0 R"), book([(1, b"<< ((( ")])):
        with pytest.raises(ValueError):
            pdf.read(bad)
    deep = book([(k, b"<< /Next %d 0 R >>" % (k + 1)) for k in range(1, 3000)], "/Root 1 0 R")
    assert len(pdf.read(pdf.write(*pdf.read(deep)))[0]) == 2999
    for predictor in (12, 15):
        rows = np.arange(60, dtype=np.uint8).reshape(6, 10)
        coded = b"".join(b"\2" + bytes(r - (rows[k - 1] if k else 0)) for k, r in enumerate(rows))
        parms = {"Filter": "/FlateDecode", "DecodeParms": f"<< /Predictor {predictor} /Columns 10 >>"}
        assert pdf.inflated(parms, zlib.compress(coded)) == rows.tobytes()


def test_placements_and_merging(spark):
    data = book(sample(smooth(40, 60), np.zeros((60, 60), np.uint8)))
    table = spark.createDataFrame([("a", bytearray(data)), ("bad", bytearray(b"no"))], "path string, content binary")
    placed = {r.key: (r.width_pt, r.height_pt) for r in documents.placements(pdf.page_operators(table)).collect()}
    assert placed == {"4_0": (300, 200), "5_0": (100, 60), "7_0": (600, 400)}
    rows = pdf.objects(table).where("error is null").drop("error")
    fonts = {r.key: r.canonical for r in documents.merged(documents.font_programs(rows)).collect()}
    assert fonts == {"10_0": "10_0", "11_0": "10_0"}
    moved = documents.redirected(rows, documents.merged(documents.font_programs(rows)))
    got = {r.key: r for r in moved.collect()}
    assert got["13_0"].dict["FontFile2"] == "10 0 R" and "11 0 R" not in got["12_0"].dict["F"] and got["12_0"].dict["F"].count("10 0 R") == 2
    assert all(r["dst"] != "11_0" for row in got.values() for r in row.refs)
    bare = {r.key: r for r in docgraph.strip_metadata(rows).collect()}
    assert bare["9_0"].dict == {} and "Metadata" not in bare["1_0"].dict and "Thumb" not in bare["3_0"].dict and len(bare) == len(got)


def test_documents(spark):
    px, scan = smooth(400, 600), np.full((700, 700), 255, np.uint8)
    scan[100:600:9, 50:650] = 0
    data = book(sample(px, scan))
    tiny = book([(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [] /Count 0 >>")], "/Root 1 0 R")
    table = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(tiny)), ("bad", bytearray(b"no"))], "path string, content binary")
    made = {r.path: r for r in documents.compress_documents(table, 72).collect()}
    r = made["a"]
    assert (r.status, r.technique, r.pages, r.merged_images, r.merged_fonts, r.images, r.bilevel) == ("done", "pdf-bilevel", 2, 1, 1, 2, 1)
    assert r.downsampled == 2 and r.new_bytes == len(r.content) < len(data) / 5
    found, trailer = pdf.read(bytes(r.content))
    assert "5_0" not in found and "11_0" not in found and "8_0" not in found and "20_0" not in found
    photo, page = (pdf.entries(found[k][0]) for k in ("4_0", "7_0"))
    assert (photo["Width"], photo["Height"], photo["Filter"]) == ("300", "200", "/DCTDecode")
    assert pdf.raster(photo, found["4_0"][1]).shape == (200, 300, 3)
    bits = g4.decode(found["7_0"][1], int(page["Width"]), int(page["Height"]))
    assert page["Filter"] == "/CCITTFaxDecode" and 0 < bits.mean() < 0.5
    assert made["b"].technique == "untouched" and made["bad"].status.startswith("error") and bytes(made["bad"].content) == b"no"
    for target in (12000, 7000):
        r = {x.path: x for x in documents.compress_documents(table, target_bytes=target).collect()}
        assert r["a"].hit_target and r["a"].new_bytes <= target and r["b"].hit_target and r["b"].technique == "untouched"
    never = {x.path: x for x in documents.compress_documents(table, target_bytes=100).collect()}["a"]
    assert never.hit_target is False and never.new_bytes < len(data)


def test_bounded_rasters():
    px = smooth(900, 1200)
    assert rasters.bounded(px, 512).shape == (384, 512, 3) and rasters.bounded(px, 2000) is px
    assert (rasters.resized(px, 1200, 900) == px).all() and rasters.resized(px[:2, :2], 5, 7).shape == (7, 5, 3)
    assert rasters.resized(np.full((5, 7, 3), 9, np.uint8), 3, 2).tolist() == [[[9] * 3] * 3] * 2
    assert rasters.Reference(px).score(px) == 1
