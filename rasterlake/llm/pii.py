"""Personal data: strict patterns, and more spans by weak supervision, by DataFrame functions only.

Base spans are leftmost non-overlapping matches of one pattern for each kind that pass its check. On top of
these, wider patterns propose candidate spans (obfuscated addresses, numbers, keys and passwords). Labelers
vote on each candidate: regular expressions on its form, gazetteers of cue words, and its context. The votes of
all candidates are counted by combination; expectation-maximisation on these counts estimates how reliable each
labeler is, and what each combination means. With those as soft labels a final classifier, logistic on the
candidate's own form, is trained, and candidates it accepts are added where no base span lies.

Everything per document is a projection: positions come from the lengths of matches and of the pieces between
them, so a row is never split up. Only the counts of (votes, form) meet in an aggregation; their number is
bounded by the labelers' and features' values, not by the data. The fit on these counts runs on the driver.

Defined results: a null text counts as empty and has no spans; repeated rows each get their own result; an
empty table gives no rows and fits the priors; a very long text of very many matches costs a sort of its spans; a run of more than 200 digits and nothing else is no candidate; columns other than the id and text are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

_E = "[A-Za-z0-9._%+-]"
#: kind -> pattern. Possessive forms and the look-behind match just what the plain pattern does, without its
#: repeated scans and recursion on long runs: a run that fails at its start fails everywhere in it.
BASE = {
    "email": rf"(?:\G|(?<!{_E})){_E}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "secret", "id")
_KEY = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
#: Candidate families: kind -> (pattern, what a text must hold for it: implied by the pattern, and cheaper). Repeats
#: without a bound are possessive: a plain repeated group recurses in Java, and a long run would end the JVM.
CANDIDATES = {
    "secret": (rf"{_KEY}\x20?[=:]\x20?[\"']?[^\s\"',;]{{6,}}+[\"']?|(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?![0-9]{{201,}}+(?![A-Za-z_-]))[A-Za-z0-9_-]{{16,}}+", rf"[0-9]|{_KEY}\x20?[=:]"),
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]{2,}+)++", r"\(at\)|\[at\]|\{at\}|\x20at\x20\x20?[A-Za-z0-9-]++\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)"),
    "phone": (r"(?<![0-9A-Za-z+._-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])(?:[0-9]{2,4}[\x20./-]){1,3}[0-9]{2,4}(?![0-9A-Za-z_-])", "[0-9]"),
    "id": (r"(?<![0-9A-Za-z.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])", "[0-9]"),
}
CUES = {
    "secret": "password|passwd|secret|token|key|credential|auth",
    "email": "mail|contact|write|reach|address",
    "phone": "phone|tel|call|mobile|fax|contact|whatsapp",
    "id": "ssn|social|security|iban|account|passport|tax|bank",
}
AGAINST = "version|isbn|issn|doi|http|page|figure|section|license|licence|copyright|chapter|order|invoice|commit|sha|build|vol"
STRICT = {
    "secret": rf"^(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{20,}}|sk_[A-Za-z0-9_]{{16,}}|eyJ[A-Za-z0-9_-]{{16,}}|{_KEY}\x20?[=:].*)$",
    "email": r"[(\[{](?:at|dot)[)\]}]",
    "phone": r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$",
    "id": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}",
}
LABELERS = ("strict form", "cue word", "assignment before it", "mixed characters", "word against it", "unit after it")
CONTEXT = 32
#: Characters of a chunk of text, by which a candidate's surroundings are found without a walk from the text's start.
CHUNK = 1024
EM_ROUNDS, PSEUDO, FIT_ROUNDS = 40, 8.0, 500


def _starts(gaps: Column, sizes: Column) -> Column:
    """Where each match starts: running sums in three levels, so that many matches in a text stay cheap."""
    k = 64
    steps = F.zip_with(F.slice(gaps, 1, F.size(sizes)), F.concat(F.array(F.lit(0)), sizes), lambda g, m: F.coalesce(g, F.lit(0)) + F.coalesce(m, F.lit(0)))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    floor = lambda n: F.floor(n / k).cast("int")
    sums = lambda xs: F.transform(F.sequence(F.lit(0), floor(F.size(xs))), lambda c: add(F.slice(xs, c * k + 1, F.lit(k))))
    held = F.array(F.struct(steps.alias("d")))
    held = F.transform(held, lambda h: F.struct(h["d"].alias("d"), sums(h["d"]).alias("c")))
    held = F.transform(held, lambda h: F.struct(h["d"].alias("d"), h["c"].alias("c"), sums(h["c"]).alias("b")))
    some = lambda xs, i: add(F.slice(xs, floor(i) * k + 1, i % k))
    first = lambda h, n: add(F.slice(h["b"], F.lit(1), floor(floor(n)))) + some(h["c"], floor(n)) + some(h["d"], n)
    return F.transform(held, lambda h: F.transform(F.sequence(F.lit(0), F.size(h["d"]) - 2), lambda i: first(h, i + 1)))[0]


def find(df: DataFrame, text: str, out: str, pattern: str, holds: Column) -> DataFrame:
    """Adds `out`: array of (start, end, s) of all matches, in code points; empty unless `holds`."""
    m, p = f"{out}__m", f"{out}__p"
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(holds, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none))
    size = F.transform(m, F.length)
    spans = F.zip_with(m, _starts(F.transform(p, F.length), size), lambda s, a: F.struct(a.alias("start"), (a + F.length(s)).alias("end"), s.alias("s")))
    nothing = F.array().cast("array<struct<start:int,end:int,s:string>>")
    return df.withColumn(out, F.when(F.size(m) > 0, spans).otherwise(nothing)).drop(m, p)


def _passes(kind: str, s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "ip":
        return s.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _passes(kind, x["s"])


def _span(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds b_<kind> for every base kind."""
    df = df.withColumn("has_digit", F.col(text).rlike("[0-9]"))
    for kind, pattern in BASE.items():
        holds = F.contains(text, F.lit("@")) if kind == "email" else F.col("has_digit") & F.contains(text, F.lit("+" if kind == "phone" else "." if kind == "ip" else ""))
        df = find(df, text, f"b_{kind}", pattern, holds)
        df = df.withColumn(f"b_{kind}", F.filter(f"b_{kind}", _check(kind)))
    return df.drop("has_digit")


def _before(values: Column, others: Column, at_ties: bool) -> Column:
    """For each of the ascending `values` how many of `others` are less, or equal with `at_ties`: one sort of both."""
    of = lambda xs, own, tie: F.transform(xs, lambda v: F.struct(v.alias("v"), F.lit(tie).alias("tie"), F.lit(own).alias("own")))
    both = F.sort_array(F.concat(of(values, True, int(at_ties)), of(others, False, int(not at_ties))))
    placed = F.filter(F.transform(both, lambda x, i: F.struct(x["own"].alias("own"), i.alias("i"))), lambda p: p["own"])
    return F.transform(placed, lambda p, k: p["i"] - k)


def _free(found: Column, taken: Column) -> Column:
    """Of ascending disjoint matches those that overlap no span of `taken`: as many spans begin before a match's end as
    end at its start or before."""
    begun = _before(F.transform(found, lambda x: x["end"]), F.transform(taken, lambda t: t["a"]), False)
    ended = _before(F.transform(found, lambda x: x["start"]), F.transform(taken, lambda t: t["z"]), True)
    told = F.zip_with(found, F.zip_with(begun, ended, lambda a, b: a == b), lambda x, free: F.struct(x.alias("x"), free.alias("free")))
    return F.when((F.size(found) == 0) | (F.size(taken) == 0), found).otherwise(F.transform(F.filter(told, lambda x: x["free"]), lambda x: x["x"]))


def _near(start: Column, size: Column) -> Column:
    """`size` characters of the text from `start`, at most CHUNK, out of the chunks that hold them."""
    j = F.floor(start / CHUNK).cast("int")
    held = F.concat(F.coalesce(F.get("chunks", j), F.lit("")), F.coalesce(F.get("chunks", j + 1), F.lit("")))
    return F.substring(held, start - j * CHUNK + 1, size)


def _candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds `cand`: array of (kind, start, end, votes, form), without what overlaps a base span."""
    for kind, (pattern, holds) in CANDIDATES.items():
        df = find(df, text, f"c_{kind}", pattern, F.col(text).rlike(holds))
    taken = F.concat(*(F.transform(f"b_{k}", lambda x: F.struct(x["start"].alias("a"), x["end"].alias("z"))) for k in BASE))
    some = reduce(lambda a, b: a | b, (F.size(f"c_{k}") > 0 for k in CANDIDATES))
    chunks = F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    df = df.withColumns({"taken": taken, "chunks": chunks})

    def described(kind: str) -> Column:
        free = _free(F.col(f"c_{kind}"), F.col("taken"))
        if kind == "phone":
            free = F.filter(free, lambda x: F.length(F.regexp_replace(x["s"], "[^0-9]", "")).between(9, 15) & ~x["s"].rlike(STRICT["id"]))
        begun = lambda x: F.greatest(x["start"] - CONTEXT, F.lit(0))
        seen = F.transform(free, lambda x: F.struct(x["start"], x["end"], x["s"], F.lower(_near(begun(x), x["start"] - begun(x))).alias("left"), _near(x["end"], F.lit(4)).alias("right")))
        return F.transform(seen, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _votes(kind, x["s"], x["left"], x["right"]).alias("votes"), _form(kind, x["s"], x["left"]).alias("form")))

    return df.withColumn("cand", F.concat(*map(described, CANDIDATES))).drop("taken", "chunks", *(f"c_{k}" for k in CANDIDATES))


def _votes(kind: str, s: Column, left: Column, right: Column) -> Column:
    """A character for each labeler: + for, - against, 0 abstains."""
    yes = lambda c: F.when(c, "+").otherwise("0")
    no = lambda c: F.when(c, "-").otherwise("0")
    # a letter between digits or a digit between letters, whatever else lies between; of linear cost
    mixed = F.regexp_replace(s, "[^0-9A-Za-z]++", "").rlike("[0-9][A-Za-z]++[0-9]|[A-Za-z][0-9]++[A-Za-z]")
    flat = s.rlike(r"^(.)\1*$|^[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}$|^[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}$|^[A-Za-z]+-[A-Za-z-]+[0-9]{1,2}$")
    return F.concat(
        yes(s.rlike(STRICT[kind])),
        yes(F.concat(left, F.lower(s)).rlike(f"(?:^|[^a-z])(?:{CUES[kind]})")),
        yes(left.rlike(r"[=:]\x20?[\"']?$")),
        F.when(flat, "-").when(mixed if kind == "secret" else F.lit(False), "+").otherwise("0"),
        no(left.rlike(f"(?:{AGAINST})[^a-z]{{0,4}}$")),
        no(right.rlike(r"^\x20?(?:%|kg|km|cm|mm|EUR|USD|\$|€)")),
    )


def _form(kind: str, s: Column, left: Column) -> Column:
    """The classifier's features, each one of a few values, joined by |."""
    bucket = lambda c, *at: reduce(lambda w, a: w.when(c < a, str(a)), at[1:], F.when(c < at[0], str(at[0]))).otherwise("more")
    share = lambda rx: F.floor(4 * F.length(F.regexp_replace(s, rx, "")) / F.greatest(F.length(s), F.lit(1))).cast("string")
    before = F.when(left == "", "edge").when(left.rlike(r"[=:\"']$"), "sign").when(left.rlike(r"\s$"), "space").otherwise("other")
    return F.concat_ws("|", F.lit(kind), bucket(F.length(s), 12, 16, 20, 28, 40), share("[^0-9]"), share("[^A-Z]"), before, F.when(s.rlike(r"[=:]"), "pair").when(s.rlike(r"[\x20().]"), "split").otherwise("run"))


def estimate(counts: dict[str, float], rounds: int = EM_ROUNDS) -> tuple[list[dict], dict[str, float]]:
    """Expectation-maximisation on counts of vote combinations: each labeler's vote rates for true and false
    candidates, and each combination's probability of being true. Pseudo counts keep rates off 0 and 1."""
    signs = "+-0"
    rates = [{1: {"+": 0.5, "-": 0.1, "0": 0.4}, 0: {"+": 0.1, "-": 0.4, "0": 0.5}} for _ in LABELERS]
    first = [{y: dict(r[y]) for y in r} for r in rates]
    prior = 0.5
    post: dict[str, float] = {}
    for _ in range(rounds):
        for votes in counts:
            a = math.log(prior) + sum(math.log(r[1][v]) for r, v in zip(rates, votes, strict=True))
            b = math.log(1 - prior) + sum(math.log(r[0][v]) for r, v in zip(rates, votes, strict=True))
            post[votes] = 1 / (1 + math.exp(min(60.0, max(-60.0, b - a))))
        n1 = sum(n * post[v] for v, n in counts.items())
        n = sum(counts.values())
        prior = (n1 + PSEUDO) / (n + 2 * PSEUDO)
        for j, r in enumerate(rates):
            for y, m in ((1, n1), (0, n - n1)):
                for sign in signs:
                    got = sum(n * (post[v] if y else 1 - post[v]) for v, n in counts.items() if v[j] == sign)
                    r[y][sign] = (got + PSEUDO * first[j][y][sign]) / (m + PSEUDO)
    return rates, post


def train(rows: list[tuple[str, float, float]], rounds: int = FIT_ROUNDS, decay: float = 1.0) -> dict[str, float]:
    """Logistic weights by feature value ("position:value", "bias") from (form, soft label, count)."""
    weights: dict[str, float] = {"bias": 0.0}
    data = [(["bias", *(f"{k}:{v}" for k, v in enumerate(form.split("|")))], y, n) for form, y, n in rows]
    total = sum(n for _, _, n in data) or 1.0
    for names, _, _ in data:
        weights |= {x: 0.0 for x in names}
    # below 2 over the largest curvature, so that every step goes downhill, for one candidate as for many
    step = 1.9 / (0.25 * max((len(names) for names, _, _ in data), default=1) + decay / total)
    for _ in range(rounds):
        slope = {x: -decay * w / total for x, w in weights.items()}
        for names, y, n in data:
            gap = (y - 0.5 * (1 + math.tanh(0.5 * sum(weights[x] for x in names)))) * n / total
            for x in names:
                slope[x] += gap
        for x, g in slope.items():
            weights[x] += step * g
    return weights


def _joined(spans: Column) -> Column:
    return F.array_join(spans, ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, base (array of kind, start, end), added (likewise, by the classifier)."""
    found = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = _candidates(base_spans(found, "t"), "t").drop("t")
    slim = F.concat(*(F.transform(f"b_{k}", _span(k)) for k in BASE))
    found = Scratch(docs.sparkSession, "pii").put(found.select(id_col, slim.alias("base"), "cand"), "spans")
    counted = found.select(F.explode("cand").alias("c")).groupBy("c.votes", "c.form").count().collect()
    counts: dict[str, float] = {}
    for r in counted:
        counts[r["votes"]] = counts.get(r["votes"], 0.0) + r["count"]
    _, post = estimate(counts) if counts else ([], {})
    weights = train([(r["form"], post[r["votes"]], float(r["count"])) for r in sorted(counted)])
    known = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.lit(w))))
    score = lambda c: F.aggregate(F.split(c["form"], r"\|"), F.struct(F.lit(weights["bias"]).alias("w"), F.lit(0).alias("k")), lambda a, v: F.struct((a["w"] + F.coalesce(F.try_element_at(known, F.concat(a["k"].cast("string"), F.lit(":"), v)), F.lit(0.0))).alias("w"), (a["k"] + 1).alias("k")))["w"]
    added = F.filter("cand", lambda c: score(c) > math.log(threshold / (1 - threshold)))
    return found.select(id_col, "base", F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias("added"))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    told = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("base", _is(kind))).cast("long").alias(f"n_{kind}")
    more = lambda kind: F.size(F.filter("added", _is(kind))).cast("long").alias(f"n_added_{kind}")
    whole = [F.size("added").cast("long").alias("n_added"), *map(more, CANDIDATES), (F.size("base") + F.size("added")).cast("long").alias("n_spans")]
    order = F.concat(*(F.array_sort(F.filter(F.concat("base", "added"), _is(k))) for k in KINDS))
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(F.transform("base", told)).cast("binary"), 256).alias("base_sha256"), _joined(F.transform(order, told)).alias("spans"), *whole)
