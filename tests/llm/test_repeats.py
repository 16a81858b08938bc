import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapcat.llm import repeats, suffix

from .conftest import words


def brute(rows, width=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def corpus(rng):
    passages = [words(rng, 14, 10**6) for _ in range(4)]
    exact50 = "q" * 10 + words(rng, 9, 10**6)[:40]
    rows = []
    for _ in range(60):
        parts = [words(rng, int(rng.integers(1, 40)), 10**6) for _ in range(3)]
        parts.insert(1, str(rng.choice(passages))[int(rng.integers(0, 20)) :])
        if rng.random() < 0.3:
            parts.append(exact50[: int(rng.integers(48, 51))])
        rows.append(" ".join(parts))
    rows += [rows[0], rows[0], rows[1][:-1] + "é", "x" * 300, "x" * 120, "x" * 49, "é" * 40, "é" * 30, "", None, "ab" * 60, "ba" * 50, rows[5] + rows[6], exact50, exact50[1:]]
    return [(int(i), t) for i, t in zip(rng.permutation(10 * len(rows)), rows, strict=False)]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("id", F.lit(0)).repartition(3)
    return sorted(tuple(r) for r in repeats.remove_repeats(df, **options).collect())


def test_a_line_in_all_documents(spark, monkeypatch):
    """Its anchors are counted first, marked everywhere and dealt by document; the result is that of the brute force."""
    for name, value in (("BUCKET", 100), ("CONTEXTS", 50), ("SHARE", 20), ("FLUSH", 2000)):
        monkeypatch.setattr(repeats, name, value)
    rng = np.random.default_rng(4)
    line = words(rng, 30, 10**6)
    rows = [(i, f"{words(rng, 12, 10**6)} {line} {words(rng, int(rng.integers(1, 20)), 10**6)}" if i % 9 else f"{line} {line[:90]}") for i in range(300)]
    seen = []
    plain = repeats._recurring
    monkeypatch.setattr(repeats, "_recurring", lambda *a: seen.append(len(a[5].value)) or plain(*a))
    assert run(spark, rows) == brute(rows)
    assert seen[0] > 3


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many buckets, anchors dealt to several tasks
        for name, value in (("BUCKET", 60), ("CONTEXTS", 5), ("SHARE", 3), ("FLUSH", 400), ("OFTEN", 2)):
            monkeypatch.setattr(repeats, name, value)
    rows = corpus(np.random.default_rng(int(small)))
    expected = brute(rows)
    assert run(spark, rows) == expected
    assert sum(r[2] for r in expected) > 1000


def test_edge_cases(spark):
    assert run(spark, []) == []
    long = words(np.random.default_rng(3), 20_000, 10**6)
    rows = [(5, long), (7, "lead " + long), (7, "lead " + long), (7, "x" + long[:60]), (None, long[1000:1100])]
    got = run(spark, [r for r in rows if r[0] is not None])
    assert got == brute([r for r in rows if r[0] is not None])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in repeats.remove_repeats(df).collect()} >= {(None, 100), (5, 0)}
    assert run(spark, [(1, None), (2, ""), (3, "short")]) == brute([(1, None), (2, ""), (3, "short")])


def test_later_copies_that_pass_the_filter(spark):
    rng = np.random.default_rng(4)
    texts = [words(rng, 12, 10**6) for _ in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, t) for i, t in enumerate(texts)]
    # (a few of them do: the filter has 2 probes and at most 16 bits a key)
    got = run(spark, rows)
    assert got == brute(rows)
    assert all(r[2] == 0 for r in got[:3000])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=90), st.integers(1, 60))
def test_suffix_ranks_order_prefixes(s, depth):
    r = suffix.suffix_ranks(np.array(s, np.int64), depth)
    for i in range(len(s)):
        for j in range(i):
            x, y = s[i : i + depth], s[j : j + depth]
            assert (x < y) <= (r[i] < r[j]) and (x > y) <= (r[i] > r[j])


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=400).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 30))
def test_prefix_classes(data, width):
    n = len(data) - width + 1
    if n < 1:
        return
    c = suffix.prefix_classes(np.frombuffer(data, np.uint8), np.arange(n), width)
    seen = {}
    for i in range(n):
        assert seen.setdefault(data[i : i + width], c[i]) == c[i]
    assert len(set(c.tolist())) == len(seen)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=150).map(lambda b: bytes(x % 4 for x in b)), min_size=1, max_size=4), st.binary(min_size=50, max_size=70).map(lambda b: bytes(x % 4 for x in b)))
def test_equal_strings_choose_the_same_anchor(parts, shared):
    texts = [p + shared + q for p, q in zip(parts, reversed(parts), strict=True)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    a = repeats.Anchors(data, offsets, 50)
    which, first, last = a.chosen(np.ones(len(a.at), bool))
    by = {}
    covered = 0
    for w, lo, hi in zip(which, first, last, strict=True):
        for p in range(lo, hi + 1):
            covered += 1
            choice = (int(a.at[w]) - p, int(a.hashes[w]))
            assert 0 <= choice[0] <= 30
            assert by.setdefault(data[p : p + 50].tobytes(), choice) == choice
    assert covered == sum(max(0, len(t) - 49) for t in texts)
