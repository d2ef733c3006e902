import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import exprs as E
from rasterlake.operators import budget, docgraph, documents, g4, images, palette, runs, similarity
from rasterlake.sources import files, rasters


def lcg(seed):
    while True:
        seed = int(float(seed) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        yield seed


def patterns():
    h, w = 97, 113
    y, x = np.mgrid[0:h, 0:w]
    r = lcg(12345)
    yield "white", np.zeros((h, w), int)
    yield "black", np.ones((h, w), int)
    yield "vstripes", (x >> 3) % 2 == 0
    yield "hstripes", (y >> 2) % 2 == 0
    yield "checker", ((x >> 2) + (y >> 2)) % 2 == 0
    yield "diagonal", (x + y) % 17 < 3
    yield "noise", np.array([(next(r) >> 16) % 5 == 0 for _ in range(h * w)]).reshape(h, w)
    yield "textish", (y % 24 <= 16) & (x % 11 < 7) & (((7 * x + 13 * y) % 23) % 4 != 0)
    y, x = np.mgrid[0:30, 0:3000]
    yield "longruns", (y % 3 == 0) & (x > 2700)


@pytest.mark.parametrize("name,bitmap", list(patterns()))
def test_g4_round_trip(name, bitmap):
    bitmap = bitmap.astype(np.uint8)
    assert (g4.decode(g4.encode(bitmap), bitmap.shape[1], bitmap.shape[0]) == bitmap).all()


@pytest.mark.parametrize("length", [0, 63, 64, 1728, 1791, 1792, 2559, 2560, 2623, 2624, 5248])
def test_run_codes_agree(spark, length):
    row = spark.range(1).select(*(runs.run_code(F.lit(length), F.lit(b)).alias(f"c{int(b)}") for b in (False, True))).first()
    assert (row.c0, row.c1) == (g4._run_bits(length, 0), g4._run_bits(length, 1))


def test_codes_are_prefix_free():
    for own in (runs.WHITE_TERMINATING + runs.WHITE_MAKEUP + runs.SHARED_MAKEUP, runs.BLACK_TERMINATING + runs.BLACK_MAKEUP + runs.SHARED_MAKEUP, [*runs.VERTICAL.values(), runs.PASS, runs.HORIZONTAL]):
        assert len(set(own)) == len(own)
        assert not [(a, b) for a in own for b in own if a != b and b.startswith(a)]


def test_median_cut_with_one_dominant_colour():
    assert len(palette.cut({0: 900, 31: 50, 1023: 50}, 2)) == 2
    boxes = palette.cut({0: 900, 31: 50, 1023: 50}, 3)
    assert sorted(b for box in boxes for b in box) == [0, 31, 1023] and all(boxes)
    assert palette.cut({}, 4) == [] and palette.cut({5: 1}, 4) == [[5]]


def test_split_matches_the_loop(spark):
    rng = np.random.default_rng(1)
    counts = {int(b): int(n) for b, n in zip(rng.choice(32768, 60, False), rng.integers(1, 50, 60), strict=True)}
    bins = spark.createDataFrame([(1, b, n) for b, n in counts.items()], "k int, bin int, n long")
    made = palette.split_once(bins, ["k"]).collect()
    want = palette.cut(counts, 2)
    assert sorted(r.bin for r in made if r.side == 0) == sorted(want[0]) and sorted(r.bin for r in made if r.side == 1) == sorted(want[1])


def test_rasters_round_trip_and_edges():
    rng = np.random.default_rng(2)
    for shape in ((1, 1, 3), (5, 7, 3), (16, 9, 4)):
        px = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (rasters.decode_png(rasters.encode_png(px)) == px).all()
        assert (rasters.decode_bmp(rasters.encode_bmp(px[..., :3])) == px[..., :3]).all()
    flat = np.full((8, 8, 3), 255, np.uint8)
    assert rasters.otsu(flat) == 0 and rasters.bilevel(flat).sum() == 0 and rasters.bilevel(flat * 0).sum() == 64
    assert rasters.otsu(np.zeros((0, 0, 3), np.uint8)) == 128
    assert rasters.ssim(flat[:7, :7], flat[:7, :7]) == 1.0 and rasters.ssim(flat, flat) == 1.0
    clear = np.zeros((4, 4, 4), np.uint8)
    assert len(rasters.quantize(clear, 8)[1]) == 0
    assert rasters.quantize(flat, 8)[1].tolist() == [[252, 252, 252]]


def test_ctm_restore_on_empty_stack(spark):
    m = "named_struct('a',2D,'b',0D,'c',0D,'d',3D,'e',0D,'f',0D)"
    ops = ", ".join(f"named_struct('op','{o}','m',{m},'obj','x')" for o in ("transform", "save", "transform", "paint", "restore", "paint", "restore", "paint"))
    out = docgraph.page_paints(spark.sql(f"select 'a' path, 'p' page, array({ops}) ops")).orderBy("seq").collect()
    assert [(r.width, r.height) for r in out] == [(4.0, 9.0), (2.0, 3.0), (1.0, 1.0)]


def random_steps(rng, n):
    ops = [rng.choice(("save", "transform", "paint", "restore", "restore")) for _ in range(n)]
    return [(op, tuple(rng.choice((0.5, 1.0, 2.0, -1.0, 0.0)) for _ in range(6)) if op == "transform" else None) for op in ops]


def test_parts_of_a_stream_have_the_effect_of_the_whole():
    rng = random.Random(1)
    for _ in range(200):
        steps = random_steps(rng, rng.randrange(40))
        want = list(docgraph.replay(steps))
        now, saved, got = docgraph.IDENTITY, [], []
        while len(got) < len(steps):
            part = steps[len(got) : len(got) + rng.randint(1, 7)]
            taken, end, left = docgraph.summary(part)
            got += docgraph.replay(part, now, saved)
            of = lambda k, now=now, saved=tuple(saved): now if not k else saved[-k] if k <= len(saved) else docgraph.IDENTITY
            saved = saved[: len(saved) - min(taken, len(saved))] + [docgraph.product(m, of(k)) for m, k in left]
            now = docgraph.product(end[0], of(end[1]))
        assert got == want


@pytest.mark.parametrize("span", [1, 3, 1000, 1 << 20])
def test_streams_of_rows_are_replayed_in_parts(spark, span):
    rng = random.Random(span)
    streams = {s: random_steps(rng, n) for s, n in (("a", 60), ("b", 1), ("c", 25))}
    rows = [(s, 2 * k, op, *(m or [None] * 6), f"o{k}") for s, steps in streams.items() for k, (op, m) in enumerate(steps)]
    events = spark.createDataFrame(rows, "s string, seq long, op string, a double, b double, c double, d double, e double, f double, obj string").repartition(3)
    got = {(r.s, r.seq): (r.width, r.height) for r in docgraph.replayed_rows(events, "s", span).collect()}
    want = {(s, 2 * k): docgraph.extents(m) for s, steps in streams.items() for k, ((op, _), m) in enumerate(zip(steps, docgraph.replay(steps), strict=True)) if op == "paint"}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_long_streams_are_replayed_in_linear_time(spark):
    import time

    def took(n):
        steps = [("save", None)] * (n // 4) + [("transform", (1.0, 0.0, 0.0, 1.0, 1.0, 0.0)), ("paint", None)] * (n // 4) + [("restore", None)] * (n // 4)
        start = time.perf_counter()
        assert sum(1 for _ in docgraph.replay(steps)) == len(steps) and docgraph.summary(steps)[0] == 0
        return time.perf_counter() - start

    took(1000)
    assert took(200_000) < 60 * took(20_000)
    steps = [("save", None), ("transform", (1.0, 0.0, 0.0, 1.0, 1.0, 0.0)), ("paint", None)] * 20_000 + [("restore", None), ("paint", None)] * 20_000
    rows = [("a", k, op, *(m or [None] * 6), "x") for k, (op, m) in enumerate(steps)]
    events = spark.createDataFrame(rows, "s string, seq long, op string, a double, b double, c double, d double, e double, f double, obj string")
    assert docgraph.replayed_rows(events, "s", 9000).where("width = 1 and height = 1").count() == 40_000


def test_many_short_streams_are_replayed_task_by_task(spark, tmp_path):
    """Streams of a few rows far apart, as users' events are: not one call for each (before: two for each part of a stream).
    Odd ids and missing users count as in SQL."""
    import time

    import duckdb
    from tests.conftest import rows_of

    from rasterlake.plans import catalogue, oracle

    table = "SELECT id * 1501 % 60000 - 9 AS event_id, CASE WHEN id % 50 > 0 THEN id % 4000 END AS user_id, CASE WHEN id % 7 > 0 THEN id % 151 + 0.5D END AS value, 'x' AS event_type FROM range(12000)"
    rows = spark.sql(f"{table} UNION ALL SELECT NULL, 1L, 2D, 'x'")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    start = time.perf_counter()
    got = catalogue.ctm_replay(spark, str(tmp_path)).toPandas()
    assert time.perf_counter() - start < 20
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert rows_of(got) == rows_of(duck.execute(oracle.ORACLE_SQL["ctm_replay"]).df())
    far = rows.where("user_id is not null").selectExpr("user_id", "event_id * 1000000 seq", "'paint' op", *(f"1D {c}" for c in "abcdef"), "'o' obj")
    assert "CoGroup" not in docgraph.replayed_rows(far, "user_id", 4096)._jdf.queryExecution().toString()


def test_placement_scopes_differ(spark):
    rows = [("f", "p1", 0, 5, "x", 2.0, 2.0), ("f", "p1", 0, 6, "x", 3.0, 1.0), ("f", "p1", 0, 7, "x", 4.0, 1.0), ("f", "p2", 1, 1, "x", 9.0, 9.0), ("f", "p2", 1, 2, "y", 0.0, 4.0), ("f", "p2", 1, 3, None, 8.0, 8.0), ("g", "p1", 0, 1, "x", 1.0, 1.0)]
    paints = spark.createDataFrame(rows, "path string, page string, place int, seq int, obj string, width double, height double")
    got = lambda scope: sorted(tuple(r) for r in docgraph.placements(paints, scope).collect())
    assert got("page") == [("f", "x", 2.0, 2.0), ("g", "x", 1.0, 1.0)] and got("document") == [("f", "x", 9.0, 9.0), ("g", "x", 1.0, 1.0)]
    with pytest.raises(ValueError):
        docgraph.placements(paints, "file")


def test_nearest_entries_of_large_palettes(spark):
    rng = random.Random(2)
    entries = [(k, rng.randrange(20), rng.randrange(20)) for k in range(70)]
    points = [(k, rng.randrange(20), rng.randrange(20)) for k in range(50)]
    table = lambda rows, name: spark.createDataFrame(rows, f"{name} long, r long, g long")
    want = {k: min((((r - x) ** 2 + (g - y) ** 2), e) for e, x, y in entries) for k, r, g in points}
    for most in (100, 70, 16, 1):
        got = similarity.nearest(table(points, "px"), table(entries, "idx"), "px", ["r", "g"], most).collect()
        assert {r.px: (r.distance, r.entry) for r in got} == want


def test_resampling_by_area(spark):
    rng = np.random.default_rng(3)
    for (h, w), (th, tw) in (((6, 9), (4, 3)), ((5, 7), (5, 7)), ((2, 3), (5, 4)), ((8, 8), (1, 1))):
        g = rng.integers(0, 256, (h, w))
        rows = [(1, x, y, int(g[y, x])) for y in range(h) for x in range(w)]
        px = spark.createDataFrame(rows, "image long, x long, y long, g long")
        made = similarity.resampled(px, spark.createDataFrame([(1, w, h, tw, th)], "image long, w long, h long, to_w long, to_h long"), "image")
        fine = np.repeat(np.repeat(g, th, axis=0), tw, axis=1).reshape(th, h, tw, w).mean(axis=(1, 3))
        assert {(r.x, r.y): r.g for r in made.collect()} == {(x, y): int(np.floor(fine[y, x] + 0.5)) for y in range(th) for x in range(tw)}


def test_reachable_through_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "key string")
    assert {r.key: r.depth for r in docgraph.reachable(edges, roots).collect()} == {"a": 0, "b": 1, "c": 2}
    objects = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    assert sorted(r.key for r in docgraph.collect_garbage(objects, edges, roots).collect()) == ["d", "e"]


def test_reachable_has_no_silent_bound(spark):
    chain = [(f"b{k}", f"b{k + 1}") for k in range(103)]
    edges = spark.createDataFrame(chain, "src string, dst string").coalesce(1).cache()
    roots = spark.createDataFrame([("b0",)], "key string").coalesce(1)
    assert {r.key: r.depth for r in docgraph.reachable(edges, roots).collect()} == {f"b{k}": k for k in range(104)}
    with pytest.raises(ValueError):
        docgraph.collect_garbage(roots, edges, roots, max_depth=2)


def test_every_pair_meets_the_floor_test(spark):
    from rasterlake.catalogue import QUERIES
    from tests.conftest import DATA

    scores = {r.vec_id: r.ssim for r in QUERIES["ssim_pairs"](spark, DATA).collect()}
    assert min(scores.values()) < 0
    assert {r.vec_id: r.passes for r in QUERIES["ssim_floor_filter"](spark, DATA).collect()} == {k: v >= 0.965 for k, v in scores.items()}


def test_grid_equals_bisection(spark):
    rows = spark.range(200).withColumn("t", F.col("id") / 100)
    made = {r.id: (r.fits, r.value) for r in budget.fit(rows, lambda v: v * v * 1.9, 0.15, 1.0, 6, F.col("t")).collect()}
    for k, (fits, value) in made.items():
        v = documents.largest_fit(lambda x: x * x * 1.9, 0.15, 1.0, 6, k / 100)
        assert fits == (v is not None) and abs(value - (0.15 if v is None else v)) < 1e-12


def test_names_and_sizes(spark):
    rows = spark.createDataFrame([("a.tar.gz",), (".bashrc",), ("noext",), ("a.b\n.c",)], "n string")
    assert [r[0] for r in rows.select(E.strip_extension(F.col("n"))).collect()] == ["a.tar", ".bashrc", "noext", "a.b\n"]
    sizes = spark.createDataFrame([(0,), (-3,), (1023,), (1484,), (1485,), (102400,), (5 * 1024**3,)], "n long")
    assert [r[0] for r in sizes.select(E.format_bytes(F.col("n"))).collect()] == ["0 B", "0 B", "1023 B", "1.4 KB", "1.5 KB", "100 KB", "5.0 GB"]
    assert spark.range(1).select(E.reduction_pct(F.lit(0), F.lit(5)), E.reduction_pct(F.lit(200), F.lit(50))).first()[:] == (0.0, 75.0)


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    flat = np.zeros((64, 64, 3), np.uint8)
    flat[:, 32:] = (10, 200, 30)
    photo = rng.integers(0, 256, (32, 32, 3), dtype=np.uint8)
    (tmp_path / "flat.bmp").write_bytes(rasters.encode_bmp(flat))
    (tmp_path / "photo.png").write_bytes(rasters.encode_png(photo))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    (tmp_path / "page.html").write_bytes(b"<p>")
    got = files.read_files(spark, str(tmp_path))
    assert sorted(r.name for r in got.collect()) == ["broken.png", "flat.bmp", "photo.png"]
    made = {r.path.rsplit("/", 1)[1]: r for r in images.compress_images(got).collect()}
    assert made["flat.bmp"].technique in ("palette", "lossless-png") and made["flat.bmp"].new_bytes < made["flat.bmp"].original_bytes
    assert made["photo.png"].technique == "ssim-search" and made["photo.png"].ssim >= 0.98 and made["broken.png"].status.startswith("error")
    small = {r.path.rsplit("/", 1)[1]: r for r in images.compress_images(got, target_bytes=1500).collect()}
    assert small["photo.png"].new_bytes < 3000
    back = {r.path.rsplit("/", 1)[1]: r for r in images.convert_images(got, "png").collect()}
    assert (rasters.decode(back["flat.bmp"].content) == flat).all()
    assert {r.status for r in images.convert_images(got, "webp").collect()} == {"unsupported"}
    said = {r.path.rsplit("/", 1)[1]: r for r in images.analyse_images(got).collect()}
    assert said["flat.bmp"].image_class in ("flat", "bilevel") and said["flat.bmp"].g4_bytes > 0
    whole = files.decode_images(spark, str(tmp_path / "photo.png")).first()
    assert (np.frombuffer(whole.bgr, np.uint8).reshape(32, 32, 3)[..., ::-1] == photo).all()
    jobs = spark.createDataFrame([(1, "a.png", b"1", 0), (1, "a.png", b"2", 1), (1, "b.png", b"3", 2), (2, "c.png", b"4", 0)], "job int, name string, content binary, ord int")
    zips = {r.job: (r.n, bytes(r.archive)[:2]) for r in files.zip_archives(jobs, "job", "name", "content", "ord").collect()}
    assert zips == {1: (2, b"PK"), 2: (1, b"4")}


def test_pdf_graph(spark):
    from rasterlake.sources import pdf

    px = np.random.default_rng(4).integers(0, 256, (40, 30, 3), dtype=np.uint8)
    pictures = spark.createDataFrame([(1, k, rasters.encode_png(px)) for k in range(2)], "job int, ord int, content binary")
    made = pdf.images_to_pdf(pictures, "job", "ord", "content").selectExpr("'a.pdf' path", "pdf content")
    broken = spark.createDataFrame([("b.pdf", b"no")], "path string, content binary")
    rows = pdf.objects(made.union(broken)).cache()
    assert rows.where("error is not null").count() == 1
    graph = rows.where("key is not null")
    found = docgraph.candidate_images(graph)
    assert {r.path for r in graph.collect()} == {"a.pdf"}
    assert sorted(r.key for r in found.collect()) == ["4_0", "7_0"]
    from rasterlake.operators import keyed

    same = {r.key: r.canonical for r in keyed.canonical(found.withColumn("content", F.hex("content")), "key", "content").collect()}
    assert same == {"4_0": "4_0", "7_0": "4_0"}
    edges = graph.select(F.col("key").alias("src"), F.explode("refs").alias("r")).select("src", F.col("r.dst").alias("dst"))
    table = spark.createDataFrame(list(same.items()), "key string, canonical string")
    merged = keyed.remap(edges, "dst", table, "key")
    roots = spark.createDataFrame([("1_0",)], "key string")
    assert [r.key for r in docgraph.collect_garbage(graph.where("kind <> 'trailer'").select("key"), merged, roots).collect()] == ["7_0"]
    pages = pdf.page_operators(made.union(broken)).collect()
    assert [[o.op for o in r.ops] for r in pages] == [["save", "transform", "paint", "restore"]] * 2


def test_stream_of_files(spark, tmp_path):
    from rasterlake.sources import jpeg
    from rasterlake.streaming.ingest import compress_stream
    from tests.test_documents import book, sample, smooth

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bmp").write_bytes(rasters.encode_bmp(np.zeros((16, 16, 3), np.uint8)))
    (tmp_path / "in/b.JPEG").write_bytes(jpeg.encode(smooth(40, 40), 0.98)[0])
    (tmp_path / "in/c.pdf").write_bytes(book(sample(smooth(40, 60), np.zeros((60, 60), np.uint8))))
    (tmp_path / "in/d.txt").write_bytes(b"not taken")
    compress_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), files_per_batch=2).awaitTermination()
    reports = {r.path[-5:]: r for r in spark.read.parquet(str(tmp_path / "out/reports")).collect()}
    contents = {r.path[-5:]: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "out/contents")).collect()}
    assert set(reports) == set(contents) == {"a.bmp", ".JPEG", "c.pdf"} and {r.status for r in reports.values()} == {"done"}
    assert all(len(contents[k]) == r.new_bytes < r.original_bytes for k, r in reports.items() if r.technique != "untouched") and reports["c.pdf"].kind == "pdf"
    assert (rasters.decode(contents["a.bmp"])[..., :3] == 0).all()
    # later files come in a later batch, to a sink of one's own
    seen = []
    (tmp_path / "in/e.bmp").write_bytes(rasters.encode_bmp(np.zeros((24, 16, 3), np.uint8)))
    compress_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), sink=lambda rows, n: seen.append((n, rows.count()))).awaitTermination()
    assert [n for _, n in seen] == [1]
