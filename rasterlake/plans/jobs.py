"""Queries of the batch queue and of the steps of document compression over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as E
from ..operators import docgraph, documents, keyed, queue, similarity


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queue_counts(spark, sf_dir):
    status = F.col("o_orderstatus")
    return queue.counts(_t(spark, sf_dir, "orders"), ["o_orderpriority"], done=status == "F", waiting=status == "O", failed=status == "P")


def queue_edit(spark, sf_dir):
    files = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("waiting").alias("status"))
    orders = _t(spark, sf_dir, "orders")
    gone = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct()
    patch = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("status"))
    more = _t(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).alias("id"), F.col("n_name").alias("name"), F.lit("new").alias("status"))
    return queue.appended(queue.patched(queue.without(files, gone, "id"), patch, "id"), more)


def page_numbers(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    of = Window.partitionBy("l_orderkey")
    page = F.row_number().over(of.orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", page.alias("page"), F.count(F.lit(1)).over(of).alias("pages"))


def labels_and_limits(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"), F.floor(F.col("p_retailprice")).alias("price"))
    parsed = E.parse_size(F.col("n"), F.when(F.col("p_partkey") % 2 == 0, "KB").otherwise("MB"))
    notes = F.concat(F.array(E.plural(F.col("n") % 3, "image")), F.when(F.col("n") % 2 == 0, F.array(F.lit("merged"))).otherwise(F.array().cast("array<string>")))
    return p.select("p_partkey", E.percent_label(F.col("n") / 50).alias("scale"), F.array_join(notes, "; ").alias("notes"), parsed.alias("bytes"), E.target_within(parsed, F.col("price")).alias("target"), E.base_scale(F.col("n")).alias("base_scale"))


def first_decode(spark, sf_dir):
    """Events without a value stand for pages on which an image isn't decoded."""
    decoded = _t(spark, sf_dir, "events").where(F.col("value").isNotNull()).select("user_id", "event_type", "event_id")
    return keyed.first_rows(decoded, ["user_id", "event_type"], F.col("event_id"))


def attach_placement(spark, sf_dir):
    """Lines of few pieces stand for paints without extent, so that some parts have no placement."""
    lines = _t(spark, sf_dir, "lineitem").where("l_quantity > 25")
    placed = docgraph.largest_placement(lines, ["l_partkey"], F.col("l_quantity").cast("double"), [-F.col("l_orderkey"), -F.col("l_linenumber"), -F.col("l_suppkey")], F.struct("l_quantity", "l_orderkey"))
    part = _t(spark, sf_dir, "part")
    return part.join(placed, part["p_partkey"] == placed["l_partkey"], "left").select("p_partkey", F.col("placed.l_quantity").cast("double").alias("width_pt"), F.col("placed.l_orderkey").alias("page"))


def pack_and_flatten(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", *((F.col("s_suppkey") * k % 256).cast("int").alias(x) for x, k in zip("rgba", (7, 13, 29, 31), strict=True)))
    return s.select("s_suppkey", E.pack_rgb(F.col("r"), F.col("g"), F.col("b")).cast("long").alias("packed"), *(F.round(E.flatten_white(F.col(x), F.col("a")), 6).alias(f"flat_{x}") for x in "rgb"))


def whole_windows(spark, sf_dir):
    px = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_orderkey") % 61).alias("x"), (F.col("l_partkey") % 47).alias("y"), (F.col("l_suppkey") % 50 + 10).alias("width"), (F.col("l_suppkey") % 37 + 9).alias("height"))
    return similarity.whole_tiles(px).groupBy("image", "tx", "ty").agg(F.count(F.lit(1)).alias("n"))


def font_merge(spark, sf_dir):
    items = _t(spark, sf_dir, "documents").select(F.col("lang").alias("path"), F.col("doc_id").alias("key"), F.col("doc_id").alias("ord"), F.col("text").cast("binary").alias("content"))
    return documents.merged(items).select(F.col("key").alias("doc_id"), F.col("canonical").alias("canonical_id"))


def image_plan(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 90).cast("long").alias("w"), (F.col("p_size") * 60).cast("long").alias("h"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") * 18.0).alias("wp"))
    w, h, smaller = documents.plan(F.col("w"), F.col("h"), F.col("wp"), F.col("wp") / 2, K.DPI_PRESETS[1])
    return p.select("p_partkey", w.alias("base_w"), h.alias("base_h"), smaller.alias("downsampled"))


def size_estimate(spark, sf_dir):
    cents = lambda c: F.floor(c * 100 + F.lit(0.5)).cast("long")
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents(F.col("l_extendedprice"))).alias("held"), F.sum(cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("coded"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", cents(F.col("o_totalprice") * 2).alias("saved"))
    made = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("estimate", documents.estimated_size(F.col("saved"), F.col("held"), F.col("coded")))
    return made.select("o_orderkey", "estimate", (F.col("estimate") <= documents.allowed_size(F.col("saved"))).alias("fits"))


def nested_refs(spark, sf_dir):
    ref = F.concat(F.col("c_nationkey").cast("string"), F.lit(" 0 R"))
    key = lambda c: F.concat(c.cast("string"), F.lit("_0"))
    value = F.create_map(F.lit("Kids"), F.concat(F.lit("[ << /N "), ref, F.lit(" /M [ 100"), ref, F.lit(" ] >> ]")))
    rows = _t(spark, sf_dir, "customer").select(F.lit("a").alias("path"), key(F.col("c_custkey")).alias("key"), value.alias("dict"), F.lit(None).cast("string").alias("body"), F.array(F.struct(key(F.col("c_nationkey")).alias("dst"), F.lit("Kids").alias("entry"))).alias("refs"))
    nation = _t(spark, sf_dir, "nation")
    first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    moves = nation.join(first, "n_regionkey").select(F.lit("a").alias("path"), key(F.col("n_nationkey")).alias("key"), key(F.col("first")).alias("canonical"))
    made = documents.redirected(rows, moves)
    return made.select(F.col("key").alias("obj"), F.col("dict")["Kids"].alias("kids"), F.col("refs")[0]["dst"].alias("dst"))


def _objects(spark, sf_dir):
    n = F.col("p_partkey") % 4
    kind = F.when(n == 0, "/Catalog").when(n == 1, "/Page").otherwise("/Font")
    own = F.create_map(*(x for k in ("Metadata", "Thumb", "Title") for x in (F.lit(k), F.lit("1 0 R"))), F.lit("Type"), kind)
    refs = F.array(*(F.struct(F.lit("1_0").alias("dst"), F.lit(k).alias("entry")) for k in ("Metadata", "Thumb", "Title")))
    part = _t(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("path"), F.col("p_partkey").cast("string").alias("key"), F.lit("dict").alias("kind"), own.alias("dict"), refs.alias("refs"))
    info = part.groupBy(F.col("p_brand").alias("path")).agg(F.min("p_partkey").cast("string").alias("info"))
    trailer = info.select("path", F.lit("trailer").alias("key"), F.lit("trailer").alias("kind"), F.create_map(F.lit("Info"), F.col("info")).alias("dict"), F.array(F.struct(F.col("info").alias("dst"), F.lit("Info").alias("entry"))).alias("refs"))
    return rows.unionByName(trailer)


def metadata_strip(spark, sf_dir):
    made = docgraph.strip_metadata(_objects(spark, sf_dir)).where("kind <> 'trailer'")
    return made.select(F.col("key").cast("long").alias("p_partkey"), F.array_join(F.array_sort(F.map_keys("dict")), ",").alias("entries"), F.size("refs").cast("long").alias("refs"))


def recompressible(spark, sf_dir):
    n = F.col("p_partkey")
    pairs = [F.struct(F.lit(k).alias("k"), F.when(flag, v).alias("v")) for k, flag, v in (("Subtype", n % 2 == 0, "/Image"), ("SMask", n % 3 == 0, "1 0 R"), ("ImageMask", n % 5 == 0, "true"), ("Mask", n % 7 == 0, "2 0 R"))]
    own = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.when(n % 11 != 0, "stream").otherwise("dict").alias("kind"), own.alias("dict"), F.repeat(F.lit("x"), (F.col("p_size") * 100).cast("int")).alias("content"))
    return docgraph.candidate_images(rows).select("p_partkey", F.length("content").cast("long").alias("bytes"))


NAMES = (queue_counts, queue_edit, page_numbers, labels_and_limits, first_decode, attach_placement, pack_and_flatten, whole_windows, font_merge, image_plan, size_estimate, nested_refs, metadata_strip, recompressible)
QUERIES = {f.__name__: f for f in NAMES}

ORACLE_SQL: dict[str, str] = {
    "queue_counts": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS waiting, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1",
    "queue_edit": """SELECT c_custkey AS id, c_name AS name, coalesce((SELECT max(o_orderpriority) FROM orders WHERE o_custkey = c_custkey), 'waiting') AS status FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT -n_nationkey - 1, n_name, 'new' FROM nation""",
    "page_numbers": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS page,
  count(*) OVER (PARTITION BY l_orderkey) AS pages FROM lineitem""",
    "labels_and_limits": """WITH p AS (SELECT p_partkey, p_size::BIGINT AS n, floor(p_retailprice)::BIGINT AS price, p_size::BIGINT * CASE WHEN p_partkey % 2 = 0 THEN 1024 ELSE 1048576 END AS bytes FROM part)
SELECT p_partkey, floor(n / 50 * 100 + 0.5)::BIGINT || '%' AS scale, (n % 3) || ' image' || CASE WHEN n % 3 = 1 THEN '' ELSE 's' END || CASE WHEN n % 2 = 0 THEN '; merged' ELSE '' END AS notes,
  bytes, least(bytes, price) AS target, CASE WHEN n > 15 THEN 1.0 ELSE 1.5 END::DOUBLE AS base_scale FROM p""",
    "first_decode": "SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "attach_placement": """WITH b AS (SELECT l_partkey, l_quantity, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem WHERE l_quantity > 25)
SELECT p_partkey, l_quantity::DOUBLE AS width_pt, l_orderkey AS page FROM part LEFT JOIN b ON l_partkey = p_partkey AND k = 1""",
    "pack_and_flatten": """WITH s AS (SELECT s_suppkey, s_suppkey * 7 % 256 AS r, s_suppkey * 13 % 256 AS g, s_suppkey * 29 % 256 AS b, s_suppkey * 31 % 256 AS a FROM supplier)
SELECT s_suppkey, (r * 65536 + g * 256 + b)::BIGINT AS packed, round((r * a + 255 * (255 - a))::DOUBLE / 255, 6) AS flat_r, round((g * a + 255 * (255 - a))::DOUBLE / 255, 6) AS flat_g, round((b * a + 255 * (255 - a))::DOUBLE / 255, 6) AS flat_b FROM s""",
    "whole_windows": """WITH p AS (SELECT l_suppkey AS image, l_orderkey % 61 AS x, l_partkey % 47 AS y, (l_suppkey % 50 + 10) // 8 * 8 AS w, (l_suppkey % 37 + 9) // 8 * 8 AS h FROM lineitem)
SELECT image, (x // 8)::BIGINT AS tx, (y // 8)::BIGINT AS ty, count(*) AS n FROM p WHERE x < w AND y < h GROUP BY ALL""",
    "font_merge": "SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS canonical_id FROM documents",
    "image_plan": """WITH p AS (SELECT p_partkey, p_size * 90 AS w, p_size * 60 AS h, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 18.0::DOUBLE END AS wp FROM part),
d AS (SELECT *, CASE WHEN wp IS NOT NULL THEN greatest(w / (wp / 72), h / (wp / 2 / 72)) END AS dpi, greatest(w, h) AS e FROM p),
s AS (SELECT *, greatest(e * CASE WHEN dpi IS NULL OR dpi <= 300 THEN 1.0 ELSE 300.0::DOUBLE / dpi END, least(e, 220)::DOUBLE) / e AS k FROM d),
b AS (SELECT p_partkey, w, h, greatest(1, floor(w * k + 0.5))::BIGINT AS base_w, greatest(1, floor(h * k + 0.5))::BIGINT AS base_h FROM s)
SELECT p_partkey, base_w, base_h, base_w < w OR base_h < h AS downsampled FROM b""",
    "size_estimate": """WITH l AS (SELECT l_orderkey, sum(floor(l_extendedprice * 100 + 0.5::DOUBLE)::BIGINT)::BIGINT AS held, sum(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5::DOUBLE)::BIGINT)::BIGINT AS coded FROM lineitem GROUP BY 1),
e AS (SELECT o_orderkey, floor(o_totalprice * 2 * 100 + 0.5::DOUBLE)::BIGINT AS saved, held, coded FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, saved - held + coded AS estimate, saved - held + coded <= saved * 0.99::DOUBLE AS fits FROM e""",
    "nested_refs": """WITH f AS (SELECT n_nationkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS first FROM nation)
SELECT c_custkey || '_0' AS obj, '[ << /N ' || first || ' 0 R /M [ 100' || c_nationkey || ' 0 R ] >> ]' AS kids, first || '_0' AS dst
FROM customer JOIN f ON n_nationkey = c_nationkey""",
    "metadata_strip": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS n, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS info FROM part)
SELECT p_partkey, CASE WHEN info THEN '' WHEN n = 0 THEN 'Thumb,Title,Type' WHEN n = 1 THEN 'Metadata,Title,Type' ELSE 'Metadata,Thumb,Title,Type' END AS entries, CASE WHEN info THEN 0 WHEN n < 2 THEN 2 ELSE 3 END::BIGINT AS refs FROM p""",
    "recompressible": "SELECT p_partkey, (p_size * 100)::BIGINT AS bytes FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_size * 100 >= 2048",
}
