"""SQL that an independent engine runs over the same tables, by query name."""

from __future__ import annotations

from ..operators import runs as R

_PX = """px AS (SELECT vec_id, label, CAST(i AS INT) AS p, CAST(least(255, greatest(0, floor(CAST(v AS DOUBLE) * 256 + 128))) AS INT) AS g
  FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings)),
lm AS (SELECT *, 0.299::DOUBLE * g + 0.587::DOUBLE * g + 0.114::DOUBLE * g AS luma FROM px)"""
_HIST = _PX + """,
hist AS (SELECT label, CAST(floor(luma) AS INT) AS t, count(*) AS n FROM lm GROUP BY ALL)"""
_OTSU = _HIST + """,
cum AS (SELECT *, CAST(sum(n) OVER a AS BIGINT) AS w, CAST(sum(t * n) OVER a AS BIGINT) AS s, CAST(sum(n) OVER g AS BIGINT) AS an, CAST(sum(t * n) OVER g AS BIGINT) AS al
  FROM hist WINDOW a AS (PARTITION BY label ORDER BY t), g AS (PARTITION BY label)),
var AS (SELECT label, t, CASE WHEN an > w THEN (w * (an - w))::DOUBLE * ((s::DOUBLE / w - (al - s)::DOUBLE / (an - w)) * (s::DOUBLE / w - (al - s)::DOUBLE / (an - w))) END AS v FROM cum),
otsu AS (SELECT label, coalesce((SELECT t FROM var i WHERE i.label = o.label AND v IS NOT NULL ORDER BY v DESC, t LIMIT 1), 0) AS threshold FROM (SELECT DISTINCT label FROM hist) o)"""
_BITS = _OTSU + """,
bm AS (SELECT vec_id, any_value(lm.label) AS label, string_agg(CASE WHEN luma <= threshold THEN '1' ELSE '0' END, '' ORDER BY p) AS bits,
  sum(CASE WHEN luma <= threshold THEN 1 ELSE 0 END)::BIGINT AS ink FROM lm JOIN otsu ON lm.label = otsu.label GROUP BY vec_id)"""
_CH = _BITS + """,
ch AS (SELECT vec_id, label, bits, list_filter(range(64), lambda i: substr(bits, i + 1, 1) <> CASE WHEN i = 0 THEN '0' ELSE substr(bits, i, 1) END) AS el FROM bm)"""
_SSIM = _PX + """,
m AS (SELECT a.vec_id, count(*) AS n, sum(a.g) AS sa, sum(b.g) AS sb, sum(a.g * a.g) AS saa, sum(b.g * b.g) AS sbb, sum(a.g * b.g) AS sab
  FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND a.p = b.p GROUP BY a.vec_id),
q AS (SELECT vec_id, sa::DOUBLE / n AS ma, sb::DOUBLE / n AS mb, saa::DOUBLE / n AS xa, sbb::DOUBLE / n AS xb, sab::DOUBLE / n AS xy FROM m),
sc AS (SELECT vec_id, ((2 * ma * mb + 6.5025::DOUBLE) * (2 * (xy - ma * mb) + 58.5225::DOUBLE)) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * ((xa - ma * ma) + (xb - mb * mb) + 58.5225::DOUBLE)) AS score FROM q)"""
_RGB = _PX + """,
rgb AS (SELECT vec_id, label, p // 3 AS q, max(g) FILTER (p % 3 = 0) AS r, max(g) FILTER (p % 3 = 1) AS g, max(g) FILTER (p % 3 = 2) AS b FROM px WHERE p < 63 GROUP BY ALL),
hb AS (SELECT label, CAST(((r >> 3) << 10) | ((g >> 3) << 5) | (b >> 3) AS INT) AS bin, count(*) AS n FROM rgb GROUP BY ALL)"""
_SPLIT = _RGB + """,
ax AS (SELECT label, bin, n, bin >> 10 AS x0, (bin >> 5) & 31 AS x1, bin & 31 AS x2 FROM hb),
bx AS (SELECT label, max(x0) - min(x0) AS s0, max(x1) - min(x1) AS s1, max(x2) - min(x2) AS s2, sum(n) AS total, count(*) AS bins FROM ax GROUP BY label),
aa AS (SELECT ax.*, total, bins, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS axis FROM ax JOIN bx ON ax.label = bx.label),
rr AS (SELECT *, row_number() OVER w - 1 AS pos, sum(n) OVER w AS run FROM aa
  WINDOW w AS (PARTITION BY label ORDER BY CASE axis WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END, bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sp AS (SELECT label, bin, n, axis, CASE WHEN bins < 2 OR pos <= least(coalesce(min(CASE WHEN run * 2 >= total THEN pos END) OVER (PARTITION BY label), bins - 1), bins - 2) THEN 0 ELSE 1 END AS side FROM rr),
pm AS (SELECT label, side, sum(((bin >> 10) + 0.5::DOUBLE) * 8 * n) / sum(n) AS r, sum((((bin >> 5) & 31) + 0.5::DOUBLE) * 8 * n) / sum(n) AS g, sum(((bin & 31) + 0.5::DOUBLE) * 8 * n) / sum(n) AS b, sum(n)::BIGINT AS count FROM sp GROUP BY label, side)"""
_EDGES = """e(src, dst) AS (
  SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
walk(key, depth) AS (SELECT 'r' || r_regionkey, 0 FROM region WHERE r_regionkey < 2 UNION SELECT dst, depth + 1 FROM walk JOIN e ON src = key WHERE depth < 6),
seen AS (SELECT key, min(depth) AS depth FROM walk GROUP BY key)"""
_NAMES = """nm AS (SELECT page_id, regexp_extract(url, '([^/]+)/?$', 1) || ['.tar.gz', '.png', '', '.JPEG'][page_id % 4 + 1] AS name,
  CASE WHEN page_id % 4 = 0 THEN 'pdf' ELSE 'image' END AS kind, CASE WHEN page_id % 5 < 4 THEN ['JPG', 'PNG', 'WebP', 'JPEG'][page_id % 5 + 1] END AS label,
  CASE WHEN page_id % 2 = 0 THEN 'auto' ELSE 'bmp' END AS chosen FROM pages),
st AS (SELECT *, regexp_replace(name, '(?s)^(.+)\\.[^.]*$', '\\1') AS stem,
  coalesce(CASE lower(label) WHEN 'jpg' THEN 'jpg' WHEN 'png' THEN 'png' WHEN 'webp' THEN 'webp' WHEN 'avif' THEN 'avif' WHEN 'bmp' THEN 'bmp' END, CASE chosen WHEN 'bmp' THEN 'bmp' END) AS ext FROM nm),
nn AS (SELECT page_id, name, CASE WHEN kind = 'pdf' THEN stem || '-compressed.pdf' WHEN ext IS NOT NULL THEN stem || '.' || ext ELSE name END AS out_name FROM st)"""


def _table(codes: list[str]) -> str:
    return "[" + ", ".join(f"'{c}'" for c in codes) + "]"


def _code(terminating: list[str], makeup: list[str]) -> str:
    blocks = "(CASE WHEN length >= 2624 THEN (length - 2624) // 2560 + 1 ELSE 0 END)"
    rest = f"(length - {blocks} * 2560)"
    return f"repeat('{R.SHARED_MAKEUP[-1]}', {blocks}) || CASE WHEN {rest} < 64 THEN '' WHEN {rest} // 64 <= 27 THEN {_table(makeup)}[{rest} // 64] ELSE {_table(R.SHARED_MAKEUP)}[{rest} // 64 - 27] END || {_table(terminating)}[{rest} % 64 + 1]"


def _next(test: str) -> str:
    return f"coalesce(list_min(list_filter(el, lambda x, i: x > 31{test})), 64)::INT"


def _run(length: str, black: str) -> str:
    """The code of a run of less than 64 pixels, by colour."""
    return f"CASE WHEN {black} THEN {_table(R.BLACK_TERMINATING)}[{length} + 1] ELSE {_table(R.WHITE_TERMINATING)}[{length} + 1] END"


#: Boxes of bins, the widest of which (by spread and population) is split in every step.
_CUT = _RGB + """,
mc(label, bin, n, box, pos, step) AS (SELECT label, bin, n, 0::BIGINT, row_number() OVER (PARTITION BY label ORDER BY bin), 1 FROM hb
UNION ALL SELECT label, bin, n, CASE WHEN box > cut_at OR (box = cut_at AND rk > last_left) THEN box + 1 ELSE box END, CASE WHEN box = cut_at THEN rk ELSE pos END, step + 1
FROM (SELECT *, least(min(CASE WHEN run * 2 >= tot THEN rk END) OVER (PARTITION BY label, box), cnt - 1) AS last_left
FROM (SELECT *, row_number() OVER o AS rk, sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
FROM (SELECT *, min(CASE WHEN score = top_score AND top_score > 0 THEN box END) OVER (PARTITION BY label) AS cut_at, CASE WHEN w0 >= w1 AND w0 >= w2 THEN x0 WHEN w1 >= w2 THEN x1 ELSE x2 END AS c
FROM (SELECT *, max(score) OVER (PARTITION BY label) AS top_score
FROM (SELECT *, CASE WHEN cnt > 1 THEN greatest(w0, w1, w2) * log2((tot + 1)::DOUBLE) ELSE 0 END AS score
FROM (SELECT *, max(x0) OVER b - min(x0) OVER b AS w0, max(x1) OVER b - min(x1) OVER b AS w1, max(x2) OVER b - min(x2) OVER b AS w2, sum(n) OVER b AS tot, count(*) OVER b AS cnt
FROM (SELECT *, bin >> 10 AS x0, (bin >> 5) & 31 AS x1, bin & 31 AS x2 FROM mc WHERE step < 16) WINDOW b AS (PARTITION BY label, box)))))
WINDOW o AS (PARTITION BY label, box ORDER BY c, pos))))"""
#: Rows of 8 pixels as changing elements, and the coding position moved along each until it leaves the row.
_G4 = _BITS + """,
ro AS (SELECT vec_id, y, list_filter(range(8), lambda i: substr(bits, y * 8 + i + 1, 1) <> CASE WHEN i = 0 THEN '0' ELSE substr(bits, y * 8 + i, 1) END) AS own FROM bm, unnest(range(8)) u(y)),
ra AS (SELECT vec_id, y, own, coalesce(lag(own) OVER (PARTITION BY vec_id ORDER BY y), []) AS above FROM ro)"""
_PAST = "len(list_filter({0}, lambda x: x <= a0))"
_FIRST = "({0} + CASE WHEN {0} % 2 <> colour THEN 1 ELSE 0 END)"
_MOVES = """,
mv(vec_id, y, own, above, a0, colour, code) AS (SELECT vec_id, y, own, above, -1, 0, '' FROM ra
UNION ALL SELECT vec_id, y, own, above, CASE WHEN b2 < a1 THEN b2 WHEN abs(a1 - b1) <= 3 THEN a1 ELSE a2 END::INT, CASE WHEN b2 >= a1 AND abs(a1 - b1) <= 3 THEN 1 - colour ELSE colour END,
  code || CASE WHEN b2 < a1 THEN '{pass_}' WHEN abs(a1 - b1) <= 3 THEN {vertical}[a1 - b1 + 4] ELSE '{horizontal}' || {one} || {two} END
FROM (SELECT *, coalesce(own[ka + 1], 8) AS a1, coalesce(own[ka + 2], 8) AS a2, coalesce(above[kb + 1], 8) AS b1, coalesce(above[kb + 2], 8) AS b2
  FROM (SELECT *, {ka} AS ka, {kb} AS kb FROM mv WHERE a0 < 8))),
al AS (SELECT vec_id, string_agg(code, '' ORDER BY y) || '{end}' AS code FROM mv WHERE a0 >= 8 GROUP BY vec_id),
pd AS (SELECT vec_id, code || repeat('0', (8 - len(code) % 8) % 8) AS code FROM al)""".format(
    pass_=R.PASS, horizontal=R.HORIZONTAL, end=R.END, vertical=_table([R.VERTICAL[d] for d in range(-3, 4)]),
    one=_run("(a1 - greatest(a0, 0))", "colour = 1"), two=_run("(a2 - a1)", "colour = 0"), ka=_FIRST.format(_PAST.format("own")), kb=_FIRST.format(_PAST.format("above")),
)
_NIBBLE = "(CASE WHEN {0} = '1' THEN {1} ELSE 0 END)"
_HEX = "substr('0123456789ABCDEF', 1 + " + " + ".join(_NIBBLE.format(f"substr(code, 4 * i + {k + 1}, 1)", 8 >> k) for k in range(4)) + ", 1)"
#: Graphics states of each stream of operators, event by event: matrix in force and stack.
_PRODUCT = "[m[1] * c[1] + m[2] * c[3], m[1] * c[2] + m[2] * c[4], m[3] * c[1] + m[4] * c[3], m[3] * c[2] + m[4] * c[4], m[5] * c[1] + m[6] * c[3] + c[5], m[5] * c[2] + m[6] * c[4] + c[6]]"
_REPLAY = f"""ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id % 4 AS op, coalesce(value, 0.0)::DOUBLE / 100 AS v FROM events),
st(user_id, k, op, c, stack) AS (SELECT user_id, 0::BIGINT, 9::BIGINT, [1.0::DOUBLE, 0, 0, 1, 0, 0], CAST([] AS DOUBLE[][]) FROM ev GROUP BY user_id
UNION ALL SELECT user_id, k, op, CASE op WHEN 1 THEN {_PRODUCT} WHEN 3 THEN coalesce(stack[-1], [1.0::DOUBLE, 0, 0, 1, 0, 0]) ELSE c END,
  CASE op WHEN 0 THEN list_append(stack, c) WHEN 3 THEN stack[:-2] ELSE stack END
FROM (SELECT ev.user_id, ev.k, ev.op, c, stack, [v, 0.5::DOUBLE, -0.5::DOUBLE, v, 1.0::DOUBLE, 2.0::DOUBLE] AS m FROM st JOIN ev ON ev.user_id = st.user_id AND ev.k = st.k + 1))"""

_PICK = "struct_pack(a := l_quantity * l_extendedprice, o := -l_orderkey, s := -l_suppkey, n := -l_linenumber)"

ORACLE_SQL: dict[str, str] = {
    "dedup_savings": """WITH c AS (SELECT source, strlen(text) AS n, doc_id = min(doc_id) OVER (PARTITION BY text) AS own FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS o, coalesce(sum(n) FILTER (own), 0)::BIGINT AS k, count(*) - count(*) FILTER (own) AS m FROM c GROUP BY source)
SELECT source, o AS original_bytes, k AS new_bytes, greatest(o - k, 0) AS saved_bytes, round(CASE WHEN o <= 0 THEN 0.0 ELSE (o - k)::DOUBLE / o * 100 END, 6) AS reduction_pct, m AS merged FROM s""",
    "dedup_canonical": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical_id FROM documents",
    "ref_remap": """WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS now FROM documents)
SELECT l.doc_id AS src, coalesce(now, l.doc_id) AS dst, quality FROM labels l LEFT JOIN c ON l.doc_id = c.doc_id""",
    "unreferenced": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "reachability": f"WITH RECURSIVE {_EDGES} SELECT depth, count(*) AS objects FROM seen GROUP BY depth",
    "garbage": f"WITH RECURSIVE {_EDGES}, obj AS (SELECT src AS key FROM e UNION SELECT dst FROM e) SELECT key[1] AS kind, count(*) AS removed FROM obj WHERE key NOT IN (SELECT key FROM seen) GROUP BY ALL",
    "tone_histogram": f"WITH {_HIST} SELECT * FROM hist",
    "otsu_threshold": f"WITH {_OTSU} SELECT * FROM otsu",
    "bilevel_bitmap": f"WITH {_BITS} SELECT vec_id, bits, ink FROM bm",
    "content_class": f"""WITH {_PX}, s AS (SELECT vec_id, g, CASE WHEN lag(g) OVER (PARTITION BY vec_id ORDER BY p) = g THEN 1 ELSE 0 END AS same, CASE WHEN luma <= 40 OR luma >= 215 THEN 1 ELSE 0 END AS ext FROM lm),
a AS (SELECT vec_id, least(count(DISTINCT g), 4096) AS unique_colors, sum(same)::DOUBLE / count(*) AS flatness, sum(ext)::DOUBLE / count(*) AS extreme_ratio FROM s GROUP BY vec_id)
SELECT *, CASE WHEN extreme_ratio >= 0.9 AND unique_colors < 4096 THEN 'bilevel' WHEN flatness >= 0.45 AND unique_colors <= 3072 THEN 'flat' ELSE 'photo' END AS image_class FROM a""",
    "ssim_pairs": f"WITH {_SSIM} SELECT vec_id, round(score, 9) AS ssim FROM sc",
    "ssim_floor_filter": f"WITH {_SSIM} SELECT vec_id, score >= 0.965 AS passes FROM sc",
    "rgb_histogram": f"WITH {_RGB} SELECT * FROM hb",
    "median_split_once": f"WITH {_SPLIT} SELECT * FROM sp",
    "palette_means": f"WITH {_SPLIT} SELECT label, side, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, count FROM pm",
    "nearest_palette": f"""WITH {_SPLIT}, en AS (SELECT label * 2 + side AS idx, floor(r + 0.5::DOUBLE)::BIGINT AS r, floor(g + 0.5::DOUBLE)::BIGINT AS g, floor(b + 0.5::DOUBLE)::BIGINT AS b FROM pm),
d AS (SELECT vec_id * 21 + q AS px, idx, (rgb.r - en.r) * (rgb.r - en.r) + (rgb.g - en.g) * (rgb.g - en.g) + (rgb.b - en.b) * (rgb.b - en.b) AS d FROM rgb, en)
SELECT px, arg_min(idx, struct_pack(d := d, i := idx)) AS entry, min(d) AS distance FROM d GROUP BY px""",
    "changing_elements": f"WITH {_CH} SELECT vec_id, el::INT[] AS elements FROM ch",
    "run_lengths": f"""WITH {_CH}, ed AS (SELECT vec_id, list_concat([0], el, [64]) AS ed FROM ch)
SELECT vec_id, unnest(range(len(ed) - 1))::INT AS run, unnest(list_transform(range(1, len(ed)), lambda i: ed[i + 1] - ed[i]))::INT AS length FROM ed""",
    "next_change": f"WITH {_CH} SELECT vec_id, {_next('')} AS any_change, {_next(' AND i % 2 = 1')} AS from_white, {_next(' AND i % 2 = 0')} AS from_black FROM ch",
    "run_codes": f"SELECT length::INT AS length, n, {_code(R.WHITE_TERMINATING, R.WHITE_MAKEUP)} AS white, {_code(R.BLACK_TERMINATING, R.BLACK_MAKEUP)} AS black FROM (SELECT length(coalesce(text, \'\')) % 6000 AS length, count(*) AS n FROM documents GROUP BY 1)",
    "median_cut": f"WITH RECURSIVE {_CUT} SELECT label, bin, box::INT AS box FROM mc WHERE step = 16",
    "g4_encode": f"WITH RECURSIVE {_G4}{_MOVES} SELECT vec_id, (SELECT string_agg({_HEX}, '' ORDER BY i) FROM unnest(range(len(code) // 4)) u(i)) AS code FROM pd",
    "ctm_replay": f"WITH RECURSIVE {_REPLAY} SELECT user_id, count(*) AS paints, round(sum(sqrt(c[1] * c[1] + c[2] * c[2])), 6) AS width, round(sum(sqrt(c[3] * c[3] + c[4] * c[4])), 6) AS height FROM st WHERE op = 2 GROUP BY user_id",
    "g4_row_reference": f"WITH {_CH} SELECT vec_id, coalesce(lag(el::INT[]) OVER (PARTITION BY label ORDER BY vec_id), []) AS reference FROM ch",
    "placement_max": f"""SELECT l_partkey, -max({_PICK}).o AS l_orderkey, -max({_PICK}).s AS l_suppkey, -max({_PICK}).n AS l_linenumber, round(max({_PICK}).a, 2) AS area FROM lineitem GROUP BY l_partkey""",
    "effective_dpi": """WITH p AS (SELECT p_partkey, p_size * 100 AS w, p_size * 80 AS h, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END AS wp, p_retailprice / 2 AS hp FROM part),
d AS (SELECT p_partkey, CASE WHEN coalesce(wp, 0) <> 0 AND coalesce(hp, 0) <> 0 THEN greatest(w / (wp / 72), h / (hp / 72)) END AS dpi FROM p)
SELECT p_partkey, round(dpi, 9) AS dpi, round(CASE WHEN dpi IS NULL OR dpi <= 150 THEN 1.0 ELSE 150.0::DOUBLE / dpi END, 9) AS scale FROM d""",
    "scaled_dims": """WITH p AS (SELECT p_partkey, p_size * 37 AS w, p_size * 23 AS h, (p_partkey % 8 + 1)::DOUBLE / 8 AS s FROM part),
q AS (SELECT *, greatest(w, h) AS e FROM p), r AS (SELECT *, greatest(e * s, least(e, 220)::DOUBLE) / e AS k FROM q)
SELECT p_partkey, greatest(16, floor(w * s + 0.5::DOUBLE))::BIGINT AS iw, greatest(16, floor(h * s + 0.5::DOUBLE))::BIGINT AS ih,
  greatest(1, floor(w * k + 0.5::DOUBLE))::BIGINT AS pw, greatest(1, floor(h * k + 0.5::DOUBLE))::BIGINT AS ph,
  CASE WHEN e <= 512 THEN greatest(1, w) ELSE greatest(1, floor(w * (512::DOUBLE / e) + 0.5::DOUBLE)) END::BIGINT AS cw,
  CASE WHEN e <= 512 THEN greatest(1, h) ELSE greatest(1, floor(h * (512::DOUBLE / e) + 0.5::DOUBLE)) END::BIGINT AS ch,
  round(least(1.0::DOUBLE, sqrt(1200000::DOUBLE / ((w * 50)::DOUBLE * (h * 50)))), 9) AS proxy, round(least(1.0::DOUBLE, 1600::DOUBLE / (2 * e)), 9) AS page,
  (54 + (24 * w + 31) // 32 * 4 * h)::BIGINT AS bmp FROM r""",
    "budget_fit": """WITH t AS (SELECT l_suppkey, round(sum(l_extendedprice), 0) AS total FROM lineitem GROUP BY l_suppkey),
v AS (SELECT *, list_max(list_filter(list_transform(range(64), lambda k: 0.15::DOUBLE + k * 0.01328125::DOUBLE), lambda v: total * v * v <= total * 0.37::DOUBLE)) AS best FROM t)
SELECT l_suppkey, best IS NOT NULL AS fits, round(coalesce(best, 0.15), 9) AS value FROM v""",
    "shrink_steps": """WITH RECURSIVE s(p_partkey, attempt, w, h) AS (SELECT p_partkey, 0, (p_size * 9)::BIGINT, (p_size * 6)::BIGINT FROM part
UNION ALL SELECT p_partkey, attempt + 1, floor(w * 0.82::DOUBLE + 0.5::DOUBLE)::BIGINT, floor(h * 0.82::DOUBLE + 0.5::DOUBLE)::BIGINT FROM s
  WHERE attempt < 9 AND floor(w * 0.82::DOUBLE + 0.5::DOUBLE) >= 16 AND floor(h * 0.82::DOUBLE + 0.5::DOUBLE) >= 16) SELECT * FROM s""",
    "winner_pick": "SELECT o_custkey, arg_min(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS o_orderkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey",
    "until_failure": "SELECT o_custkey, o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_custkey = o.o_custkey AND f.o_orderstatus = 'P' AND f.o_orderkey <= o.o_orderkey)",
    "first_seen_techniques": """WITH f AS (SELECT user_id % 10 AS g, event_type, min(event_id) AS at_ FROM events GROUP BY ALL)
SELECT g, string_agg(event_type, ',' ORDER BY at_) AS techniques FROM f GROUP BY g""",
    "batch_totals": """WITH r AS (SELECT l_returnflag, l_linestatus, floor(l_extendedprice * 100 + 0.5::DOUBLE)::BIGINT AS o, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5::DOUBLE)::BIGINT AS n FROM lineitem),
a AS (SELECT l_returnflag, count(*) AS file_count, sum(o)::BIGINT AS o, sum(n)::BIGINT AS n, greatest(max(CASE WHEN o <= 0 THEN 0.0 ELSE (o - n)::DOUBLE / o * 100 END), 0.0) AS best, count(DISTINCT l_linestatus) AS k FROM r GROUP BY l_returnflag)
SELECT l_returnflag, file_count, o AS original_bytes, n AS new_bytes, greatest(o - n, 0) AS saved_bytes, round(CASE WHEN o <= 0 THEN 0.0 ELSE (o - n)::DOUBLE / o * 100 END, 6) AS reduction_pct, round(best, 6) AS best_reduction_pct, k AS n_techniques FROM a""",
    "reports": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT AS o, floor(l_extendedprice * (1 - l_tax * 4))::BIGINT AS n FROM lineitem),
p AS (SELECT *, CASE WHEN o <= 0 THEN 0.0 ELSE (o - n)::DOUBLE / o * 100 END AS pct FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n >= o THEN 'untouched' ELSE 'lossy-resample' END AS technique, round(pct, 6) AS reduction_pct, round(greatest(0.0, least(1.0, pct / 100)), 9) AS fraction FROM p""",
    "format_bytes": """WITH s AS (SELECT doc_id, ((doc_id * doc_id * 37 + strlen(text)) * CASE WHEN doc_id % 3 = 0 THEN 1000 ELSE 1 END)::BIGINT AS n FROM documents),
u AS (SELECT *, CASE WHEN n >= 1073741824 THEN 1073741824 WHEN n >= 1048576 THEN 1048576 WHEN n >= 1024 THEN 1024 ELSE 1 END::BIGINT AS u FROM s)
SELECT doc_id, n, CASE WHEN n <= 0 THEN '0 B' WHEN u = 1 THEN n || ' B' ELSE CASE WHEN n >= 100 * u THEN ((2 * n + u) // (2 * u))::VARCHAR ELSE ((n * 20 + u) // (2 * u) // 10)::VARCHAR || '.' || ((n * 20 + u) // (2 * u) % 10)::VARCHAR END
  || CASE u WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' ELSE ' GB' END END AS said FROM u""",
    "output_names": f"WITH {_NAMES} SELECT page_id, name, out_name FROM nn",
    "zip_last_wins": f"WITH {_NAMES} SELECT regexp_replace(out_name, '[0-9]+', '', 'g') AS out_name, max(page_id) AS page_id FROM nn GROUP BY 1",
    "mime_route": """WITH m AS (SELECT ['image/png', 'application/pdf', 'image/avif', 'text/html'][event_id % 4 + 1] AS mime, CASE WHEN event_type = 'click' THEN 'webp' ELSE 'png' END AS fmt FROM events)
SELECT CASE WHEN mime LIKE 'image/%' THEN 'image' ELSE 'pdf' END AS kind, fmt, mime, count(*) AS n FROM m WHERE mime LIKE 'image/%' OR mime = 'application/pdf' GROUP BY ALL""",
    "stride_sample": """WITH r AS (SELECT l_returnflag, l_orderkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS p FROM lineitem)
SELECT l_returnflag, count(*) AS sampled, sum(l_orderkey)::BIGINT AS keys FROM r WHERE p % greatest(1, 1400000 // 200000) = 0 GROUP BY l_returnflag""",
    "parse_ref_key": """WITH r AS (SELECT CASE l_orderkey % 3 WHEN 0 THEN l_orderkey || 'R' WHEN 1 THEN l_orderkey || 'R' || l_linenumber ELSE 'x' || l_orderkey || 'R' END AS ref FROM lineitem)
SELECT ref, CASE WHEN regexp_matches(ref, '^[0-9]+R[0-9]*$') THEN regexp_extract(ref, '^([0-9]+)R', 1) || '_' || coalesce(nullif(regexp_extract(ref, 'R([0-9]*)$', 1), ''), '0') END AS key, count(*) AS n FROM r GROUP BY ALL""",
    "reorder": """SELECT n_name, CASE WHEN n_nationkey = 3 THEN 17 WHEN n_nationkey > 3 AND n_nationkey <= 17 THEN n_nationkey - 1 ELSE n_nationkey END::INT AS down,
  CASE WHEN n_nationkey = 17 THEN 3 WHEN n_nationkey >= 3 AND n_nationkey < 17 THEN n_nationkey + 1 ELSE n_nationkey END::INT AS up FROM nation""",
}
