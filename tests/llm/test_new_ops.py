"""Operators 11 to 13 against brute force."""

import base64
import hashlib
import random
from pathlib import Path
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from rasterlake.llm import audit, bytebpe, common, kmeans, queries
from tests.conftest import DATA, rows_of
from tests.llm.test_ops import words

# 11 ------------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    """Python integers all the way, no bounds."""
    import math

    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    name = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda v, c: sum((p - q) ** 2 for p, q in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j)) for _, v in kept]
        if turn == rounds:
            break
        for j in range(len(centroids)):
            some = [v for (_, v), a in zip(kept, own, strict=True) if a == j]
            if some:
                centroids[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    most = 2**63 - 1
    d = [min(most, far(v, centroids[a])) for (_, v), a in zip(kept, own, strict=True)]
    inertia = Counter()
    for a, x in zip(own, d, strict=True):
        inertia[a] += x
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, a, x, min(most, inertia[a]), min(most, sum(d)), sha[a]) for (i, _), a, x in zip(kept, own, d, strict=True)]


def table_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, x string, cluster int, n int")


def padded(rows):
    return [(i, v, 1, 2, "clash", 3, 4) for i, v in rows]


def as_floats(v):
    return v if v is None else [x if x is None else float(np.float32(x)) for x in v]


@pytest.mark.parametrize("spread,n", [(1.0, 400), (0.004, 300), (5000.0, 120)])
def test_kmeans(spark, spread, n):
    rng = random.Random(n)
    centres = [[rng.gauss(0, spread) for _ in range(64)] for _ in range(5)]
    rows = [(j, as_floats([c + rng.gauss(0, spread / 2) for c in rng.choice(centres)])) for j in range(n)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (n, rows[5][1]), (n + 1, None), (n + 2, [1.0] * 63), (n + 3, [float("nan")] * 64), (n + 4, [None] + [0.0] * 63), (n + 5, [float("inf")] * 64), (n + 6, []), (n + 7, [-0.0] * 64)]
    got = kmeans.clusters(table_of(spark, padded(rows)).repartition(3))
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_clusters(rows))


def test_kmeans_ties_and_copies(spark):
    """Components of -1, 0 and 1: distances are equal by the dozen; whole groups of copies."""
    rng = random.Random(5)
    few = [[rng.choice((-1.0, 0.0, 1.0)) / 1024 if k < 4 else 0.0 for k in range(64)] for _ in range(30)]
    rows = [(j, rng.choice(few)) for j in range(300)]
    assert Counter(tuple(r) for r in kmeans.clusters(table_of(spark, padded(rows)).repartition(4)).collect()) == Counter(plain_clusters(rows))
    same = [(j, [0.25] * 64) for j in range(50)]
    assert Counter(tuple(r) for r in kmeans.clusters(table_of(spark, padded(same))).collect()) == Counter(plain_clusters(same))


def test_kmeans_small_and_large_values(spark):
    rng = random.Random(6)
    for scale in (1e5, 1e9, 3e38):
        rows = [(j, as_floats([rng.uniform(-1, 1) * (scale if j % 3 == 0 else 1) for _ in range(64)])) for j in range(25)]
        assert Counter(tuple(r) for r in kmeans.clusters(table_of(spark, padded(rows))).collect()) == Counter(plain_clusters(rows))
    for n in (0, 1, 3):
        rows = [(j, [float(j)] * 64) for j in range(n)]
        made = kmeans.clusters(table_of(spark, padded(rows)))
        assert Counter(tuple(r) for r in made.collect()) == Counter(plain_clusters(rows))
        assert made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_kmeans_bounds_skip_calculations(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 64)) * 4
    rows = [(j, (centres[j % 8] + rng.standard_normal(64) * 0.3).astype(np.float32).tolist()) for j in range(800)]
    log = []
    kmeans.cluster(table_of(spark, padded(rows)), log=log)
    assert log[0] == 800 * 8 and sum(log[1:]) < 0.35 * 800 * 8 * (len(log) - 1)


def test_kmeans_bounds_hold():
    """After every round the bounds enclose the true distances."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.standard_normal((500, 64)) * 1000)
    a, upper, lower = np.full(500, -1, np.int32), np.full(500, np.inf), np.zeros((500, 8))
    now, before = [list(map(int, v)) for v in x[:8]], None
    for _ in range(8):
        this = kmeans.Round(now, before)
        this.assign(x, a, upper, lower)
        d = kmeans.squares(x, this.c)
        assert (a == d.argmin(axis=1)).all()
        true = np.sqrt(d.astype(np.longdouble))
        assert (upper >= true[np.arange(500), a]).all() and (lower <= true).all()
        total, n = kmeans.sums(x, a, 8), np.bincount(a, minlength=8)
        before, now = now, [[t // int(n[j]) for t in total[j]] if n[j] else now[j] for j in range(8)]


def test_limbs():
    for values in ([0], [5, -7], [2**47, -(2**47)], [2**200 + 3, -(2**150), 0], [-1]):
        parts = kmeans.limbs(values)
        assert [sum(p[k] << (kmeans.LIMB * i) for i, p in enumerate(parts)) for k in range(len(values))] == values
        assert all(abs(v) < 2**63 for p in parts for v in p)


# 12 ------------------------------------------------------------------------------------------------------------


def real_encoding():
    import public_tokenizers
    import tiktoken

    path = common.tokenizer_path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


STRANGE = [None, "", " ", "\n\n \t ", "I'm we'll THEY'RE<|endoftext|>", "naïve  ﬁ ﷺ 日本語 😀👩‍👩‍👧", "\x00\x01 a\x00b\x7f", "▁a ▁", "<unk> <s> <0x0A>", "ā Ā ſ ƀ", "x" * 20000, "ab " * 5000, "́́é", "\x1c\x85  　.", "12345 ½ ² Ⅻ 一二", "\U0010ffff￾", "aaaa" * 700 + "b", "don't've 's"]


def test_byte_bpe(spark):
    path, pattern, real = real_encoding()
    rows = [(k, t, 1, "clash", [1]) for k, t in enumerate(STRANGE)] + [(3, STRANGE[3], 1, "clash", [1]), (None, "no id", 1, "clash", [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, decoded string, ids array<int>").repartition(3)
    got = bytebpe.encode_documents(docs, path, pattern, output="ids").collect()
    text = {i: t for i, t, *_ in rows}
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        ids = real.encode_ordinary(text[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (text[r.doc_id] or "").encode()
    for r in bytebpe.encode_documents(docs, path, pattern).collect():
        ids = real.encode_ordinary(text[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()
    back = bytebpe.decode_documents(bytebpe.encode_documents(docs, path, pattern, output="ids"), path, pattern).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((i, (t or "").encode()) for i, t, *_ in rows)
    assert bytebpe.encode_documents(docs.limit(0), path, pattern).count() == 0


def test_byte_bpe_query_is_tiktoken(spark):
    _, _, real = real_encoding()
    docs = {r.doc_id: r.text or "" for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()}
    got = queries.QUERIES["op12_bytebpe"](spark, DATA).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        ids = real.encode_ordinary(docs[r.doc_id])
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(real.decode_bytes(ids)).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_byte_bpe_table_starts_anew_and_bad_bytes(spark, monkeypatch):
    path, pattern, real = real_encoding()
    monkeypatch.setattr(bytebpe, "TABLE_WORDS", 3)
    codec = bytebpe.Codec(path, pattern)
    text = "one two three four five one two three " + "y" * 500
    assert list(map(int, codec.encode(text.encode())[0].split())) == real.encode_ordinary(text) and len(codec) <= 3
    bad = spark.sql("SELECT 1L AS doc_id, cast(x'61ff62' AS string) AS text")
    assert bytes(bytebpe.encode_documents(bad, path, pattern, output="ids").first().decoded) == "a�b".encode()


def test_bytes_and_characters_are_inverse():
    every = bytes(range(256))
    assert bytebpe.to_bytes(bytebpe.to_characters(every)) == every and len(set(bytebpe.to_characters(every))) == 256


# 13 ------------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        text, w = t or "", words(t)
        failed = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > least.get(text, i)}
        rows.append((lang or "", {f for f, v in failed.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, order, step] = [len(left), len(here), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in left + here + gone), sum(r[2] for r in here), sum(r[3] for r in here)]
                shapley[part, f] += len(here)
                gone += here
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t", "ÀÉ É", "A B", "only & one", "É" * 50 + "AAAAA" + "é" * 44]
    for _ in range(60):
        some = [rng.choice(vocabulary[: rng.choice((40, 400))]) for _ in range(rng.choice((20, 99, 100, 101, 150)))]
        some = [w.upper() if rng.random() < rng.choice((0, 0.2)) else w for w in some]
        texts.append(" ".join(some) + rng.choice(("", "", "#", " $ ", "|")))
    docs = [(rng.randrange(120) if rng.random() < 0.95 else None, rng.choice(texts), rng.choice(("en", "de", "", None))) for _ in range(150)]
    labels = [(rng.randrange(130), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(80)] + [(None, 1, 1), (5, 1, 0), (5, 0, 1), (5, None, None)]
    wide = spark.createDataFrame([(*d, "clash", 1, 2) for d in docs], "doc_id long, text string, lang string, part string, bits int, step int").repartition(4)
    known = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    made = audit.audit(wide, known)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in made.collect()}
    assert got == plain_audit(docs, labels) and made.count() == 600 * 3
    assert dict(made.dtypes)["step"] == "int" and {t for c, t in made.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    assert audit.audit(wide.limit(0), known).count() == 0
    assert audit.audit(wide, known.limit(0)).count() == 1800


def test_audit_of_long_and_many_copies(spark):
    long = "word " * 300000
    docs = [(k, "the same text", "en") for k in range(3000)] + [(9000, long, "en"), (9001, long, "en")]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got["en", "EABCD", 1][1] == 3000 and got["en", "ABCDE", 1][1] == 3000 and got["en", "ABCDE", 2][1] == 2


# SQL -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_kmeans", "op13_audit"])
def test_sql(spark, duck, name):
    made = queries.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert rows_of(made) == rows_of(want)


# 7, chunks -----------------------------------------------------------------------------------------------------


def test_jaccard_of_two_full_chunks_stays_small():
    """Twice 3,000 short near copies, all open, all of one bucket: links join them without a matrix of nodes."""
    import tracemalloc

    from rasterlake.llm import jaccard

    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 20).astype(np.uint64)

    def some(n, first):
        sets = []
        for _ in range(n):
            s = base.copy()
            at = rng.integers(0, 20, rng.integers(0, 4))
            s[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
            sets.append(np.unique(s))
        return np.arange(first, first + n), np.arange(first, first + n), sets

    a, b = some(3000, 0), some(3000, 10**6)
    tracemalloc.start()
    found = jaccard._edges(a, b, 90)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    whole = {int(n) for n, s in zip(np.concatenate([a[0], b[0]]), a[2] + b[2], strict=True) if len(np.intersect1d(s, base)) == 20}
    part = {}

    def root(x):
        while part.get(x, x) != x:
            x = part[x]
        return x

    for i, j in found:
        part[root(i)] = root(j)
    assert len({root(x) for x in whole}) == 1


def test_jaccard_of_sixty_thousand_near_copies(spark):
    """60,000 short texts around one that is none of them: each keeps 28 of its 30 words or more, so what lies together
    is told by what pairs of one change allow."""
    from rasterlake.llm import jaccard

    rng = random.Random(3)
    base = [f"w{k}" for k in range(30)]
    rows = []
    for j in range(60000):
        x = list(base)
        x[rng.randrange(30)] = f"n{rng.randrange(9)}"
        x[rng.randrange(30)] = f"n{rng.randrange(9)}"
        rows.append((j, " ".join(x)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    made = jaccard.near_duplicates(docs, 1, 90).collect()
    assert len(made) == 60000
    # every set of the base's 30 words less one, and one more, is linked with what differs by a word
    sets = {}
    for j, t in rows:
        sets.setdefault(frozenset(t.split()), j)
    parent = {s: s for s in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    by_part = {}
    for s in sets:
        for w in s:
            by_part.setdefault((len(s), s - {w}), []).append(s)
            by_part.setdefault((len(s) - 1, s - {w}), []).append(s)
    # 29 of 31: sets of 30 that differ in one word are linked, those of 29 and 30 if one is in the other
    for same in by_part.values():
        for s in same[1:]:
            if 100 * len(s & same[0]) >= 90 * len(s | same[0]):
                a, b = root(same[0]), root(s)
                parent[a] = b
    component = {}
    for s, j in sets.items():
        component[root(s)] = min(j, component.get(root(s), j))
    coarse = {}
    for r in made:
        coarse.setdefault(component[root(frozenset(rows[r.doc_id][1].split()))], set()).add(r.component_id)
    assert all(len(v) == 1 for v in coarse.values())


# 5, by blocks --------------------------------------------------------------------------------------------------


def test_bpe_by_blocks(spark, monkeypatch):
    """Small blocks, texts longer than one, words in many blocks: the joins give what the tokenizer gives to each text."""
    from tokenizers import Tokenizer

    from rasterlake.llm import bpe

    path = common.tokenizer_path("word_bpe_49k.json")
    real = Tokenizer.from_file(path)
    rng = random.Random(4)
    some = ["the", "The", "naïve", "l'été", "12a", "\u0001", "x" * 400, "ﬁ", "É", "É", "a\x00b", "<|endoftext|>", "日本"]
    rows = [(k, None if k == 5 else " ".join(rng.choice(some) for _ in range(rng.choice((0, 1, 30, 900)))), "clash", 1) for k in range(60)]
    rows += [(7, rows[7][1], "clash", 1), (None, "no id", "clash", 1), (8, " \t\n", "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, block int").repartition(3)
    text = {i: t or "" for i, t, *_ in rows[:60]}
    for size in (100, 5000, 4_000_000):
        monkeypatch.setattr(bpe, "BLOCK_BYTES", size)
        got = bpe.encode_documents(docs, path, output="ids").collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        for r in got:
            want = [real.encode(t, add_special_tokens=False).ids for t in ([text[r.doc_id], " \t\n"] if r.doc_id == 8 else [text[r.doc_id]] if r.doc_id is not None else ["no id"])]
            assert r.ids in want and r.n_tokens == len(r.ids) and r.decoded == real.decode(r.ids, skip_special_tokens=False)
    plan = bpe.encode_documents(docs, path)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan or "Join" in plan
    bad = spark.sql("SELECT 1L AS doc_id, cast(x'61ff62' AS string) AS text")
    assert bpe.encode_documents(bad, path, output="ids").first().ids == real.encode("a�b", add_special_tokens=False).ids


def test_bpe_keeps_no_copy_of_texts(spark, tmp_path):
    """What is written beside the result are lists of ids, smaller than the texts (before: blocks of texts too, and a row
    for each word of a block)."""
    from rasterlake.llm import bpe

    path = common.tokenizer_path("word_bpe_49k.json")
    rng = random.Random(5)
    some = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(4000)]
    rows = [(k, " ".join(rng.choices(some, k=1500))) for k in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    made = bpe.encode_documents(docs, path, stored=True)
    size = lambda at: sum(p.stat().st_size for p in Path(at).rglob("*.parquet"))
    root = common.Scratch.made[-1].root.removeprefix("file://").removeprefix("file:")
    assert 0 < size(root) < 0.5 * size(f"{tmp_path}/docs")
    assert sorted(made.collect()) == sorted(bpe.encode_documents(docs, path).collect())


def test_bpe_holds_a_block_in_parts(spark, tmp_path, monkeypatch):
    """No pass holds a block's texts as a whole, and a block's distinct words stay few enough for six tasks beside each other
    (before: 32 MB of text at once, with all of its words as Python objects); whole documents go to workers 1,000 at a time."""
    from types import SimpleNamespace

    import pyarrow as pa

    from rasterlake.llm import bpe

    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    text = b"word " * 10_000
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 100)), pa.array([text] * 100)], names=["id", "text"]) for k in range(0, 800, 100)]
    parts = list(bpe.Blocks.of(iter(batches)))
    size = Counter()
    for block, ids, texts, _ in parts:
        assert len(ids) == len(texts) and sum(map(len, texts)) <= 1_000_000
        size[block] += sum(map(len, texts))
    assert [i for _, ids, _, _ in parts for i in ids] == list(range(800))
    assert sum(size.values()) == 800 * len(text) and max(size.values()) <= 16_000_000
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    bpe.encode_documents(spark.read.parquet(f"{tmp_path}/docs"), common.tokenizer_path("word_bpe_49k.json"), stored=True)
    assert int(spark.conf.get(common.ARROW_ROWS)) <= 1000
