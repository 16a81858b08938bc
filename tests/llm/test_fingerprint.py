import hashlib
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from snapcat.llm import fingerprint as fp
from snapcat.llm import queries

from .conftest import words


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


M64 = (1 << 64) - 1


def xx64(data, seed):
    """XXH64 of 8 bytes or of a string, as Spark's xxhash64 gives it: signed."""
    h = xxhash.xxh64_intdigest(data, seed & M64)
    return h - (1 << 64) if h >> 63 else h


def brute_sketch(text):
    """The same hashes in plain Python: words, runs of five folded from the left, the lowest 1 / SCALE and the smallest."""
    w = [xx64(x.encode(), 42) for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    number = lambda v, seed: xx64(struct.pack("<q", v), seed)
    if len(w) >= 5:
        acc = w[: len(w) - 4]
        for k in range(1, 5):
            acc = [number(b, number(a, 42)) for a, b in zip(acc, w[k:], strict=False)]
        found = set(acc)
    else:
        seed = 42
        for x in w:
            seed = number(x, seed)
        found = {seed} if w else set()
    return sorted(h for h in found if h < fp.BOUND or h == min(found))


def brute_likeness(a, b):
    x, y = ({h for h in s if h < fp.BOUND} for s in (a, b))
    if x and y:
        return len(x & y) / min(len(x), len(y))
    return float(a[:1] == b[:1])


def test_sketch_is_a_fixed_fraction(spark):
    rng = np.random.default_rng(0)
    texts = [words(rng, 4000, 5000), words(rng, 30), "a b", "", None, "One TWO\tthree  four\nfive six"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = {r.i: r.s for r in fp.sketch(df, "t", "s").collect()}
    assert abs(len(rows[0]) * fp.SCALE / len(shingles(texts[0])) - 1) < 0.2
    assert [len(rows[i]) for i in (2, 3, 4)] == [1, 0, 0]
    assert all(rows[i] == brute_sketch(t) for i, t in enumerate(texts))


def test_merge_is_the_sketch_of_the_union(spark):
    """For sets of any sizes, and in any order."""
    rng = np.random.default_rng(3)
    sets = [sorted({int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)}) for n in (0, 1, 2, 5, 63, 64, 65, 900)]
    pairs = [(i, j, a, b, sorted({*a, *b})) for i, a in enumerate(sets) for j, b in enumerate(sets)]
    df = spark.createDataFrame(pairs, "i int, j int, a array<long>, b array<long>, c array<long>")
    own = lambda c: fp._kept(F.col(c))
    for r in df.select("i", "j", fp.merge(own("a"), own("b")).alias("m"), own("c").alias("u")).collect():
        assert r.m == r.u


def test_containment_of_very_unequal_texts_and_merge(spark):
    rng = np.random.default_rng(1)
    long = words(rng, 6000, 10**6)
    part = " ".join(long.split()[100:1300])
    half = part + " " + words(rng, 1200, 10**6)
    df = spark.createDataFrame([(long, part, half, words(rng, 900, 10**6))], "a string, b string, c string, d string")
    for c in "abcd":
        df = fp.sketch(df, c, "s" + c)
    ab, ac, ad = (fp.containment(F.col("sa"), F.col("s" + c)) for c in "bcd")
    r = df.select(ab, ac, ad, fp.merge(F.col("sa"), F.col("sd")).alias("m"), "sa", "sd").first()
    assert r[0] == 1.0 and abs(r[1] - 0.5) < 0.15 and r[2] == 0.0
    assert r.m == sorted(h for h in {*r.sa, *r.sd} if h < fp.BOUND or h == min(r.sa[0], r.sd[0]))


def test_query(spark, tmp_path, docs):
    rng = np.random.default_rng(2)
    texts = [words(rng, int(rng.integers(0, 200))) for _ in range(60)]
    texts[3], texts[4], texts[10], texts[11] = None, "", "é" * 7, "日本 " * 9000
    texts[20] = texts[21] = texts[22]
    ids = [int(x) for x in rng.permutation(2000)[:60]]
    docs([(i, t, "en", "s") for i, t in zip(ids, texts, strict=True)]).withColumn("_range", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    for ranges in (1, 12):
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        df = queries.op6_fingerprint(spark, str(tmp_path))
        assert not re.search("EvalPython|InPandas|InArrow|ExistingRDD", df._jdf.queryExecution().executedPlan().toString())
        out = {r.doc_id: r for r in df.collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        check(out, ids, texts)


def test_ranges_join_up(spark, docs):
    texts = {i: f"t{i}" for i in [*range(0, 3000, 7), -5, 10**6]}
    df = docs([(i, t, None, None) for i, t in texts.items()])
    order = sorted(texts, reverse=True)
    for rows in (3, 50, 10**6):
        got = {r._id: r._next_text for r in fp.with_next(df, most_rows=rows).collect()}
        assert got == {i: texts[order[(k + 1) % len(order)]] for k, i in enumerate(order)}


def test_ranges_are_alike_in_size_whatever_the_ids(spark, docs):
    """Clustered ids with one outlier, null ids, ids that are strings, one id many times."""
    rng = np.random.default_rng(5)
    some = [*range(10**9, 10**9 + 1500), 5, 10**17, *[None] * 600, *[77] * 600]
    texts = [f"t{int(k)} {i}" for i, k in enumerate(rng.integers(0, 40, len(some)))]
    df = docs([(i, t, None, None) for i, t in zip(some, texts, strict=True)])
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    for kind in ("long", "string"):
        key = lambda i: (0, 0) if i is None else (1, i if kind == "long" else str(i))  # noqa: B023, E731
        order = sorted(zip(some, texts, strict=True), key=lambda x: (key(x[0]), hashes[x[1]]), reverse=True)
        after = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
        out = fp.with_next(df.withColumn("doc_id", F.col("doc_id").cast(kind)), most_rows=100)
        got = {r._text: (r._next_text, r.p) for r in out.withColumn("p", F.spark_partition_id()).collect()}
        assert {t: x[0] for t, x in got.items()} == after
        rows = fp._ranged(df.withColumn("doc_id", F.col("doc_id").cast(kind)).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_h")), 27)
        sizes = [r["count"] for r in rows.groupBy("_range").count().collect()]
        assert max(sizes) < 4 * len(some) / 27 and len(sizes) > 20


def check(out, ids, texts):
    text = {i: t or "" for i, t in zip(ids, texts, strict=True)}
    order = sorted(ids, reverse=True)
    assert set(out) == set(ids)
    for k, i in enumerate(order):
        t, after = text[i], text[order[(k + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) >= (edited == t)
        if t == after:
            assert r.near_next == 1.0
        a, b, c = (brute_sketch(x) for x in (t, edited, after))
        written = lambda s: f"{fp.SCALE}:" + "".join(f"{h & M64:016X}" for h in s)
        assert (r.fingerprint, r.edited_fingerprint) == (written(a), written(b))
        assert (r.near_edited, r.near_next) == (brute_likeness(a, b), brute_likeness(a, c))
    same = {}
    for i in ids:
        assert same.setdefault(text[i], out[i].fingerprint) == out[i].fingerprint


def test_edge_cases(spark, docs):
    df = docs([(1, "a b c d e f", None, None), (1, "a b c d e f", None, None), (None, "x", None, None), (2, None, None, None)])
    out = fp.with_next(df).collect()
    assert sorted((r._id is None, r._id or 0, r._next_text) for r in out) == sorted([(False, 1, "a b c d e f"), (False, 1, "x"), (False, 2, "a b c d e f"), (True, 0, "")])
    assert fp.with_next(df.limit(0)).count() == 0
    assert fp.fingerprint_documents(df).count() == 4
