r"""Line dedup by a deletion-neighbourhood join, by DataFrame functions only.

A line (trimmed of spaces, tabs and carriage returns, at least MIN_CHARS long) goes if an earlier line, by
(document id, line number), equals it or is one character edit away: insertion, deletion or substitution. The
rule looks at the input, not at what is left, so it doesn't depend on any order of work.

Equal lines meet by a 128-bit hash; the earliest place of each is a pre-aggregated minimum.

Near lines meet by hashed variants: a line itself and the line without each one of its characters. Equal
variants with the same place left out are one substitution apart; a whole line equal to another's variant is
one insertion away. To emit variants only where they can meet, lines are sieved first: two lines of one edit
share their first or their last c characters, c being half their length (lengths 2c, 2c+1 and 2c+2 have a
common c). Only lines that share such a half with a different line emit variants, of the other part alone.
Matches are then verified by Levenshtein distance on the texts.

Every group is reduced to its earliest place, never paired: a line repeated in a third of all documents costs
one row per task. Variants are emitted once per distinct line.

Joins of tables that grow with the corpus are merge joins at every size, so that a small corpus is worked on as a
large one is.

Defined results: a null or empty text stays as it is; lines shorter than MIN_CHARS stay, however often they
repeat; rows that repeat an id are one document to this rule, and so are rows without one, which come before all
others: a line is told by id, number and content, so equal lines at one number of one id don't remove each other; a
document of which no line is left, blank ones aside, has an empty text. An empty table gives no rows. A very long text of
lines costs what its lines cost; a very long line that shares its first or last half with a different line of about its
length emits a variant for each character of the other half, each made as a string, so that work grows with the square
of the line's length (10,000 characters: 10^8 bytes hashed). Input
columns keep their names and values; internal names start with two underscores, and no input column may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

MIN_CHARS = 24
#: Longest shared half of a line whose variants are made as strings. Lines that can meet share the half, so they agree.
SPELLED = 2048
#: Longest line that Levenshtein's table compares; longer ones are compared by chunks of CHUNK characters.
TABLED, CHUNK = 256, 1024
_TRIM = " \t\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_TRIM))


def _hash(tag: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(tag), *cols)


def _classes(size: Column) -> Column:
    """The c's of a length: one for odd lengths, two for even ones."""
    c = F.floor((size - 1) / 2).cast("int")
    return F.when(size % 2 == 0, F.array(c, c + 1)).otherwise(F.array(c))


def _halves(line: Column, size: Column) -> Column:
    """Array of (key, c, side): hashes of the first and of the last c characters."""
    one = lambda side, part: lambda c: F.struct(_hash(3, F.lit(side), c, part(c)).alias("key"), c.alias("c"), F.lit(side).alias("side"))
    left = F.transform(_classes(size), one("P", lambda c: F.substring(line, F.lit(1), c)))
    right = F.transform(_classes(size), one("S", lambda c: F.substring(line, size - c + 1, c)))
    return F.concat(left, right)


def _long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """__doc, __no (from 0), __line, __size for every line that the rule looks at."""
    lines = docs.select(F.col(id_col).alias("__doc"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("__no", "__raw"))
    lines = lines.select("__doc", "__no", _trimmed(F.col("__raw")).alias("__line"))
    return lines.withColumn("__size", F.length("__line")).where(F.col("__size") >= min_chars)


def _none() -> Column:
    return F.array().cast("array<struct<role:int,a:bigint>>")


def _wanted(flag: str, made: Column) -> Column:
    return F.when(F.col(flag), made).otherwise(_none())


def _spelled_variants(part: DataFrame) -> DataFrame:
    """(__at, role, a): the variants of the part of a line that isn't shared, each hashed as a string."""
    without = lambda i: F.concat(F.substring(F.col("__rest"), F.lit(1), i - 1), F.substring(F.col("__rest"), i + 1, F.col("__m")))
    row = lambda role, place, text: F.struct(F.lit(role).alias("role"), _hash(4, F.col("__key"), place, text).alias("a"))
    each = F.sequence(F.lit(1), F.col("__m"))
    variants = F.concat(_wanted("__longer", F.array(row(0, F.lit(0), F.col("__rest")))), _wanted("__shorter", F.transform(each, lambda i: row(1, F.lit(0), without(i)))), _wanted("__same", F.transform(each, lambda i: row(2, i, without(i)))))
    return part.select("__at", F.explode(variants).alias("__v")).select("__at", "__v.*")


def _summed_variants(part: DataFrame) -> DataFrame:
    """The same variants named in constant time each: what is left of a part without its character i is the sum of
    hashed (character, place) before i, and of those after it with places less by one."""
    chars = part.select("__at", "__key", "__same", "__longer", "__shorter", F.posexplode(F.split("__rest", "", -1)).alias("__i", "__ch"))
    # of 31 bits, so that no sum over a line overflows; equal sums are verified on the texts
    term = lambda place: F.pmod(F.xxhash64(F.lit(5), "__ch", place), F.lit(1 << 31))
    chars = chars.withColumns({"__own": term(F.col("__i")), "__moved": term(F.col("__i") - 1)}).drop("__ch")
    line = Window.partitionBy("__at", "__key").orderBy("__i")
    before = F.coalesce(F.sum("__own").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole, all_moved = (F.sum(c).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in ("__own", "__moved"))
    chars = chars.select("*", whole.alias("__whole"), (before + all_moved - F.sum("__moved").over(line.rowsBetween(Window.unboundedPreceding, 0))).alias("__left"))
    row = lambda role, place, total: F.array(F.struct(F.lit(role).alias("role"), _hash(5, F.col("__key"), place, F.col(total)).alias("a")))
    first = F.when(F.col("__i") == 0, row(0, F.lit(0), "__whole")).otherwise(_none())
    variants = F.concat(_wanted("__longer", first), _wanted("__shorter", row(1, F.lit(0), "__left")), _wanted("__same", row(2, F.col("__i") + 1, "__left")))
    return chars.select("__at", F.explode(variants).alias("__v")).select("__at", "__v.*")


def _one_edit(pairs: DataFrame) -> DataFrame:
    """Pairs of different lines (__line, __other) that are one edit apart. Long lines are compared from their first
    unlike character on, which is found by chunks, then within one, so that a comparison grows with the length."""
    long = F.length("__line") > TABLED
    chunks = lambda c: F.when(long, F.regexp_extract_all(c, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    unlike = lambda a, b: (F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False) - 1).cast("int")
    chars = lambda c: F.split(F.coalesce(F.get(c, F.col("__j")), F.lit("")), "", -1)
    pairs = pairs.withColumns({"__a": chunks("__line"), "__b": chunks("__other")}).withColumn("__j", unlike("__a", "__b"))
    pairs = pairs.withColumn("__p", F.col("__j") * CHUNK + unlike(chars("__a"), chars("__b")))
    more = F.length("__line") - F.length("__other")
    rest = lambda c, skips: F.substring(c, F.col("__p") + F.when(skips, 2).otherwise(1), F.length(c))
    return pairs.where(F.when(long, rest("__line", more >= 0) == rest("__other", more <= 0)).otherwise(F.levenshtein("__line", "__other", 1) >= 0)).drop("__a", "__b", "__j", "__p")


def removed_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(__doc, __no, __h1, __near): the places and hashes of lines to remove, once each."""
    at = lambda d, n: F.struct(F.col(d).alias("d"), F.col(n).alias("n"))
    lines = _long_lines(docs, id_col, text_col, min_chars)

    # one pass over the texts names every line and its halves; what follows works on the names
    named = lines.select("__doc", "__no", _hash(1, F.col("__line")).alias("__h1"), _hash(2, F.col("__line")).alias("__h2"), _halves(F.col("__line"), F.col("__size"))["key"].alias("__keys"))
    named = scratch.put(named, "named")
    repeated = named.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n"), F.min(at("__doc", "__no")).alias("__first")).where("__n > 1").drop("__n")
    exact = named.drop("__keys").join(repeated.hint("merge"), ["__h1", "__h2"]).where(at("__doc", "__no") > F.col("__first")).select("__doc", "__no", "__h1")

    half = named.select("__doc", "__no", "__h1", F.explode("__keys").alias("__key"))
    shared = half.groupBy("__key").agg(F.min("__h1").alias("__lo"), F.max("__h1").alias("__hi")).where("__lo < __hi").select("__key")
    some = half.select("__doc", "__no", "__key").join(scratch.put(shared, "shared").hint("merge"), "__key")
    wanted = some.groupBy("__doc", "__no").agg(F.collect_set("__key").alias("__want")).withColumnsRenamed({"__doc": "__of", "__no": "__at"})

    own = F.col("__doc").eqNullSafe(F.col("__of")) & (F.col("__no") == F.col("__at"))
    near = lines.drop("__size").join(wanted.hint("merge"), own).select("__doc", "__no", "__line", F.explode("__want").alias("__key"))
    # of rows that share an id, those whose line was meant
    near = near.where(F.array_contains(_halves(F.col("__line"), F.length("__line"))["key"], F.col("__key")))
    # one row for each distinct line: its earliest place and its shared halves
    near = near.groupBy(_hash(1, F.col("__line")).alias("__h1"), _hash(2, F.col("__line")).alias("__h2"))
    near = near.agg(F.min(at("__doc", "__no")).alias("__place"), F.min("__line").alias("__line"), F.collect_set("__key").alias("__keys"))
    near = scratch.put(near.select(F.struct("__place.d", "__place.n", F.col("__h1").alias("h")).alias("__at"), "__line", "__keys", F.length("__line").alias("__size")), "near")

    size = F.col("__size")
    part = near.select("__at", "__line", "__size", F.explode(F.filter(_halves(F.col("__line"), size), lambda h: F.array_contains("__keys", h["key"]))).alias("__half"))
    # a variant can only meet one of a line of the same length, or of one character more or less
    part = part.withColumn("__key", F.col("__half.key"))
    sizes = scratch.put(part.groupBy("__key", "__size").agg((F.count(F.lit(1)) > 1).alias("__same")), "sizes")
    other = lambda step, name: sizes.select("__key", (F.col("__size") + step).alias("__size"), F.lit(True).alias(name))
    part = part.join(sizes, ["__key", "__size"]).join(other(-1, "__longer"), ["__key", "__size"], "left").join(other(1, "__shorter"), ["__key", "__size"], "left")
    part = part.where("__same or __longer or __shorter")
    rest = F.when(F.col("__half.side") == "P", F.substring(F.col("__line"), F.col("__half.c") + 1, F.col("__size"))).otherwise(F.substring(F.col("__line"), F.lit(1), F.col("__size") - F.col("__half.c")))
    part = part.select("__at", "__key", "__same", "__longer", "__shorter", rest.alias("__rest"), (F.col("__size") - F.col("__half.c")).alias("__m"), F.col("__half.c").alias("__c"))
    variants = _spelled_variants(part.where(F.col("__c") <= SPELLED))
    if (near.agg(F.max("__size")).first()[0] or 0) > 2 * SPELLED:
        variants = variants.unionByName(_summed_variants(part.where(F.col("__c") > SPELLED)))
    # role 0 meets role 1 (one is the other without a character); role 2 meets role 2 (same place left out)
    group = Window.partitionBy("a")
    first = lambda role: F.min(F.when(F.col("role") == role, F.col("__at"))).over(group)
    variants = variants.select("__at", F.when(F.col("role") == 0, first(1)).when(F.col("role") == 1, first(0)).otherwise(first(2)).alias("__by"))
    # equal places are of rows that share an id
    pairs = variants.where(at("__by.d", "__by.n") < at("__at.d", "__at.n")).distinct()
    own, other = near.select("__at", "__line"), near.select(F.col("__at").alias("__by"), F.col("__line").alias("__other"))
    checked = _one_edit(pairs.join(own, "__at").join(other, "__by"))
    close = checked.select(F.col("__at.d").alias("__doc"), F.col("__at.n").alias("__no"), F.col("__at.h").alias("__h1"))

    both = exact.withColumn("__near", F.lit(0)).unionByName(close.withColumn("__near", F.lit(1)))
    return both.groupBy("__doc", "__no", "__h1").agg(F.min("__near").alias("__near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, counts: bool = False) -> DataFrame:
    """The documents with their columns, the text without removed lines; `counts` adds n_lines, n_exact, n_near."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = removed_lines(docs, scratch, id_col, text_col, min_chars)
    gone = gone.groupBy("__doc").agg(F.collect_list(F.struct(F.col("__no").alias("no"), F.col("__h1").alias("h"), F.col("__near").alias("near"))).alias("__gone"))
    gone = scratch.put(gone, "gone")
    made = docs.join(gone.hint("merge"), docs[id_col].eqNullSafe(gone["__doc"]), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    # number and hash of a line in one, to find it among the removed by array functions of linear cost
    said = lambda no, h: F.concat_ws(":", no.cast("string"), h.cast("string"))
    out = lambda near: F.transform(F.filter("__gone", lambda g: g["near"] == near), lambda g: said(g["no"], g["h"]))
    made = made.withColumn("__names", F.when(F.col("__gone").isNotNull(), F.transform(parts, lambda x, i: said(i, _hash(1, _trimmed(x))))))
    made = made.withColumns({"__same": F.array_intersect("__names", out(0)), "__close": F.array_intersect("__names", out(1))})
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    kept = F.array_except("__names", F.concat("__same", "__close"))
    # the lines are split once: a lambda would do it again for every line
    held = F.array(F.struct(parts.alias("all"), kept.alias("kept")))
    left = F.transform(held, lambda h: F.transform(h["kept"], lambda x: F.element_at(h["all"], F.substring_index(x, ":", 1).cast("int") + 1)))[0]
    made = made.withColumn("__left", F.when(n("__same") + n("__close") > 0, left))
    text = F.when(n("__same") + n("__close") == 0, F.col(text_col)).when(F.exists("__left", lambda x: _trimmed(x) != ""), F.array_join("__left", "\n")).otherwise("")
    more = [F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), n("__same").alias("n_exact"), n("__close").alias("n_near")] if counts else []
    return made.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns), *more)


def op8_lines(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = dedup_lines(docs, counts=True)
    return made.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, unnest(range(len(parts))) AS no, unnest(parts) AS raw FROM parts),
lines AS (SELECT doc_id, no, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM raw),
uniq AS (SELECT line, min(struct_pack(d := doc_id, n := no)) AS pos, length(line) AS m FROM lines WHERE length(line) >= {MIN_CHARS} GROUP BY line),
k AS (SELECT *, unnest(CASE WHEN m % 2 = 0 THEN [m // 2 - 1, m // 2] ELSE [m // 2] END) AS c FROM uniq),
h AS (SELECT line, pos, m, c, 'P' AS side, left(line, c) AS half FROM k UNION ALL SELECT line, pos, m, c, 'S', right(line, c) FROM k),
p AS (SELECT DISTINCT a.line, a.pos, a.m, b.line AS other, b.m AS om
      FROM h a JOIN h b ON a.c = b.c AND a.side = b.side AND a.half = b.half AND b.pos < a.pos AND abs(a.m - b.m) <= 1 AND a.line <> b.line),
near AS (SELECT DISTINCT line, pos FROM p WHERE
  CASE WHEN m = om THEN len(list_filter(range(m), lambda i: left(line, i) = left(other, i) AND right(line, m - i - 1) = right(other, m - i - 1))) > 0
       WHEN m > om THEN len(list_filter(range(m), lambda i: left(line, i) || right(line, m - i - 1) = other)) > 0
       ELSE len(list_filter(range(om), lambda i: left(other, i) || right(other, om - i - 1) = line)) > 0 END),
said AS (SELECT l.doc_id, l.no, l.raw, l.line, u.pos IS NOT NULL AND struct_pack(d := l.doc_id, n := l.no) > u.pos AS same,
         n.pos IS NOT NULL AND struct_pack(d := l.doc_id, n := l.no) = n.pos AS near
  FROM lines l LEFT JOIN uniq u ON l.line = u.line LEFT JOIN near n ON l.line = n.line),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (same) AS n_exact, count(*) FILTER (near) AS n_near,
       string_agg(raw, chr(10) ORDER BY no) FILTER (NOT same AND NOT near) AS kept,
       count(*) FILTER (NOT same AND NOT near AND line <> '') AS n_left
      FROM said GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
  sha256(CASE WHEN coalesce(n_exact + n_near, 0) = 0 THEN coalesce(text, '') WHEN n_left = 0 THEN '' ELSE kept END) AS kept_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""
