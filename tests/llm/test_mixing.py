import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from snapcat.llm import mixing, packing, queries

from .conftest import words


def fill(sizes, cap=3.0):
    """Targets by sharing again and again what is above the cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def corpus(rng, n=400):
    rows = []
    for i in range(n):
        source = None if i % 17 == 0 else ["big", "small", "mid", "other", "é"][min(4, int(rng.exponential(0.9)))]
        rows.append((i, words(rng, int(rng.integers(0, 60))), "en", source))
    return [*rows, (1000, None, "en", "big"), (1001, "", "en", "only empty"), (1002, " \t\n", "en", None)]


def test_targets_and_totals(spark, docs):
    rows = corpus(np.random.default_rng(0))
    df = docs(rows).withColumn("size", F.lit("clash")).withColumn("target", F.lit(0))
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, text, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((text or "").split())
    targets = fill(sizes)
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    source, text = ({r[0]: r[k] for r in rows} for k in (3, 1))
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r.size == len((text[r.doc_id] or "").split()) and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(targets[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in taken.items():
        assert abs(t - targets[s]) <= 70
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix_sources(df.repartition(7)).collect()))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_every_boundary_once(spark, docs):
    """Copies of a source are the integers that its prefix sums cross: floor(n * rate + u) - floor(u)."""
    df = docs([(i, "a b", "en", "s" if i < 90 else "t") for i in range(100)])
    by = {}
    for r in mixing.mix_sources(df).collect():
        by.setdefault((r.source_size, r.target), []).append(r.copies)
    for (size, target), copies in by.items():
        assert abs(sum(copies) - len(copies) * target / size) < 1 and max(copies) - min(copies) <= 1


def test_mixed_documents(spark, docs):
    rows = [*corpus(np.random.default_rng(1), 120), (5, "same row", "en", "big"), (5, "same row", "en", "big"), (None, "no id", None, None)]
    df = docs(rows).withColumn("_k", F.lit("clash"))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words_of = lambda d: d.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words_of(mixed) == mixing.mix_sources(df).agg(F.sum("taken")).first()[0]
    assert mixed.groupBy("doc_id", "text").count().filter("count > 9").count() == 0
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_packing_keeps_everything(spark, docs):
    rng = np.random.default_rng(3)
    rows = [*corpus(rng, 200), (7, "w " * 9001, "en", "big"), (8, "x y z", None, None), (8, "x y z", None, None), (None, "q", None, None)]
    df = docs(rows).withColumn("bin", F.lit("clash")).withColumn("_n", F.lit("clash"))
    caps = (64, 128, 256)
    out = packing.pack_documents(df, mixing.word_count(F.col("text")), capacities=caps, shard_pieces=64)
    got = out.collect()
    expected = sorted((i is None, i or 0, n) for i, t, *_ in rows if (n := len((t or "").split())))
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert r.capacity in caps and r.used <= r.capacity and r.used > max([0, *(c for c in caps if c < r.capacity)])
        assert 0 < r.n_tokens <= 256 and r.start == r.piece * 256
    assert sum(total.values()) == sum(n for *_, n in expected) and total[8] == 2 * 3 + len(rows[8][1].split())
    fill_ = {}
    for r in got:
        fill_.setdefault((r.shard, r.bin), [r.used, 0])[1] += r.n_tokens
    assert all(a == b for a, b in fill_.values())
    bins = packing.packed_bins(out)
    assert bins.count() == len(fill_) and bins.agg(F.sum("used")).first()[0] == sum(total.values())
    assert sorted(map(str, got)) == sorted(map(str, packing.pack_documents(df.repartition(5), mixing.word_count(F.col("text")), capacities=caps, shard_pieces=64).collect()))
    assert packing.pack_documents(df.limit(0), mixing.word_count(F.col("text"))).count() == 0


def plain_pack(sizes, caps, bin_cost):
    """Best fit in plain lists: (bin of each piece, room used and capacity of each bin)."""
    bins, used, size_of = [None] * len(sizes), [], []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    for k, i in enumerate(order):
        n = sizes[i]
        fits = [(size_of[b] - used[b] - n, b) for b in range(len(used)) if used[b] + n <= size_of[b]]
        if fits:
            b = min(fits)[1]
        else:
            price = []
            for cap in sorted(c for c in caps if c >= n):
                room = cap - n
                for j in order[k + 1 :]:  # fill on with the largest that still fit
                    if sizes[j] <= room:
                        room -= sizes[j]
                price.append(((cap + bin_cost) / (cap - room), cap))
            b = len(used)
            used.append(0)
            size_of.append(min(price)[1])
        bins[i] = b
        used[b] += n
    return bins, used, [min(c for c in caps if c >= u) for u in used]


def plain_documents(rows, caps, bin_cost, shard_pieces):
    """pack_documents() in plain Python for rows (id, words): (id, piece, start, n_tokens, shard, bin, capacity, used)."""
    most, seen, pieces = max(caps), {}, []
    for i, n in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        seen[i, n] = seen.get((i, n), 0) + 1
        pieces += [(i, seen[i, n], p, min(n - p * most, most)) for p in range(-(-n // most))]
    shards = max(1, -(-len(pieces) // shard_pieces))

    def shard(i, copy, piece):
        h = 42
        for x in (i, copy, piece):
            h = h if x is None else xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return (h - (1 << 64) if h >> 63 else h) % shards

    by, out = {}, []
    for p in pieces:
        by.setdefault(shard(*p[:3]), []).append(p)
    for s, own in by.items():
        own.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1], p[2]))
        bins, used, size_of = plain_pack([p[3] for p in own], caps, bin_cost)
        out += [(i, piece, piece * most, n, s, b, size_of[b], used[b]) for (i, _, piece, n), b in zip(own, bins, strict=True)]
    return out


def test_packing_matches_brute_force(spark, docs):
    """The whole result, shards, bins and capacities, with repeated rows, null ids and long documents."""
    rng = np.random.default_rng(6)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(0, 300, 260))] + [(9, 40), (9, 40), (None, 17), (None, 17), (300, 2600), (301, 512), (302, 513)]
    df = spark.createDataFrame([(i, "w " * n) for i, n in rows], "doc_id long, text string").repartition(3)
    columns = ["doc_id", "piece", "start", "n_tokens", "shard", "bin", "capacity", "used"]
    for pieces in (64, 10_000):
        out = packing.pack_documents(df, mixing.word_count(F.col("text")), capacities=(64, 128, 256, 512), bin_cost=16, shard_pieces=pieces).select(*columns)
        expected = plain_documents(rows, (64, 128, 256, 512), 16, pieces)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)


def test_best_fit():
    bins, caps = packing.pack_sizes([60, 50, 40, 30, 10, 4, 0], [64, 100])
    used = np.bincount(bins, weights=[60, 50, 40, 30, 10, 4, 0])
    assert all(u <= c for u, c in zip(used, caps, strict=True)) and sum(caps) <= 264
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 4000, 2000)
    bins, caps = packing.pack_sizes(sizes)
    assert sizes.sum() / sum(caps) > 0.97
    assert sum(caps) <= sum(packing.pack_sizes(sizes, [4096])[1])
    assert packing.pack_sizes([]) [1] == []


def test_offsets_are_stable():
    assert 0 <= mixing.SLICES <= 256
    assert set(queries.ORACLES) >= {"op7_mix_sources", "op10_url_filter"}
