import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapcat.llm import jaccard

from .conftest import words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                part[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def near(rng, text, edits):
    w = text.split()
    for k in rng.integers(0, len(w), edits):
        w[k] = f"e{rng.integers(10**6)}"
    return " ".join(w)


def corpus(rng):
    passage = words(rng, 40, 10**6)
    rows = []
    for _ in range(25):
        base = words(rng, int(rng.integers(20, 120)), 10**6)
        rows += [base, *(near(rng, base, int(rng.integers(0, 4))) for _ in range(int(rng.integers(0, 5))))]
    hub = words(rng, 150, 10**6)
    rows += [near(rng, hub, int(rng.integers(0, 9))) for _ in range(60)]  # some pairs linked, some not
    rows += [f"{passage} {words(rng, int(rng.integers(5, 60)), 10**6)}" for _ in range(40)]
    rows += ["a b", "A  b", "b a", "", " \n", None, "a b c d e", "a b c d e f", "x " * 30, "x " * 50, rows[0].upper()]
    return [(int(i), t) for i, t in zip(rng.permutation(10 * len(rows)), rows, strict=False)]


@pytest.mark.parametrize("frequent", [2, 32])
def test_matches_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BUCKET", 500)
    rng = np.random.default_rng(frequent)
    rows = corpus(rng)
    rows += [(rows[3][0], rows[3][1]), (rows[4][0], "another text under the same id as before")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("n", F.lit(0)).repartition(3)
    got = sorted(tuple(r)[:3] for r in jaccard.jaccard_components(df).collect())
    assert got == brute(rows)
    assert sum(c != d for d, _, c in got) > 60


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    assert jaccard.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "q r s t u"), (4, None), (5, "w " * 40_000 + "end")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(None, 2): 3, (3, 2): 3, (None, 1): None, (4, 0): 4, (5, 2): 5}


def test_one_per_group(spark, docs):
    rng = np.random.default_rng(7)
    rows = [(i, t, "en", "s") for i, t in corpus(rng)]
    rows += [rows[0], rows[0], (None, None, None, None)]
    df = docs(rows).withColumn("_k", F.lit("clash"))
    kept = jaccard.one_per_group(df)
    assert kept.columns == df.columns
    expected = sorted((d for d, n, c in brute([r[:2] for r in rows if r[0] is not None]) if d == c or not n))
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(expected)) and kept.filter("doc_id is null").count() == 1


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.data())
def test_prefixes_share_enough(n, m, data):
    """Whatever prefixes are chosen: similar sets share min(l, l') of them, and what the bound behind them demands."""
    shared = data.draw(st.integers(0, min(n, m)))
    order = data.draw(st.permutations(range(n + m - shared)))
    a, b = sorted(order[:n]), sorted(order[n - shared :])
    x, y = set(a), set(b)
    if 100 * len(x & y) < 75 * len(x | y):
        return
    freq = data.draw(st.sampled_from([0, 5, 1000]))
    out = []
    for s in (a, b):
        f = np.array([freq if t % 2 else 0 for t in s])
        level, p = jaccard.choose_prefix(len(s), f, 75)
        assert p == len(s) - -(-75 * len(s) // 100) + level <= len(s)
        out.append((level, set(s[:p]), len(s) - p))
    got = len(out[0][1] & out[1][1])
    assert got >= min(out[0][0], out[1][0])
    assert got >= -(-75 * (len(a) + len(b)) // 175) - max(out[0][2], out[1][2])


def test_one_per_group_with_null_and_repeated_ids(spark, docs):
    rng = np.random.default_rng(8)
    a, b, c, d, e, f = (words(rng, 40, 10**6) for _ in range(6))
    near = f + " more"
    rows = [(None, a, "x", "s"), (None, b, "x", "s"), (None, b, "x", "s"), (7, c, "x", "s"), (7, d, "x", "s"), (7, near, "x", "s"), (3, f, "x", "s"), (None, f, "x", "s")]
    rows += [(9, e, "x", "s"), (9, e, "x", "s"), (None, None, "x", "s"), (None, " ", "x", "s"), (7, "", "x", "s")]
    got = [(r.doc_id, r.text) for r in jaccard.one_per_group(docs(rows)).collect()]
    expected = [(None, a), (None, b), (7, c), (7, d), (3, f), (9, e), (None, None), (None, " "), (7, "")]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_one_per_group_keeps_unlike_texts_of_one_id(spark, docs, kind):
    rng = np.random.default_rng(9)
    x, a, b, c = (words(rng, 30, 10**6) for _ in range(4))
    rows = [(3, x), (5, a), (5, x), (7, b), (7, c), (8, None), (8, x)]
    df = docs([(i, t, "en", "s") for i, t in rows]).withColumn("doc_id", F.col("doc_id").cast(kind))
    got = [(int(r.doc_id), r.text) for r in jaccard.one_per_group(df).collect()]
    assert sorted(got, key=repr) == sorted([(3, x), (5, a), (7, b), (7, c), (8, None)], key=repr)
    df = docs([(i, t, "en", "s") for i, t in rows] + [(None, x, "en", "s"), (None, a + " z", "en", "s")]).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")).cast(kind))
    got = [(r.doc_id and int(r.doc_id), r.text) for r in jaccard.one_per_group(df).collect()]
    assert sorted(got, key=repr) == sorted([(3, x), (5, a), (None, b), (None, c), (8, None)], key=repr)


def test_very_long_texts(spark):
    """Texts of 200 000 words and copies of them with edits; a text of one word of 3 MB."""
    rng = np.random.default_rng(10)
    long = words(rng, 200_000, 10**6)
    rows = [(1, long), (2, near(rng, long, 3000)), (3, near(rng, long, 30_000)), (4, long + " end"), (5, "x" * 3_000_000), (6, "x" * 3_000_000 + " y"), (7, " ".join(long.split()[:120_000]))]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, _, c in brute(rows)} and got[2] == got[4] == 1 and got[3] == 3
