import numpy as np
from pyspark.sql import functions as F

from snapcat.llm import components, neardup


def make(rng, n=300, dim=64):
    v = rng.standard_normal((n, dim)).astype(np.float32)
    for i in range(0, n, 5):
        v[i] = v[i - 1] + rng.standard_normal(dim) * rng.choice([0.05, 0.12, 0.18, 0.2, 0.25])
    v[7] = v[3]
    v[9] = v[3] * 2
    return v


def brute(ids, vectors, labels):
    n = len(ids)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for v, o in zip(vectors, ok, strict=True)]
    links, part = [0] * n, list(range(n))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] is not None and labels[i] == labels[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                part[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [(ids[i], links[i], least[root(i)], least[root(i)] == ids[i]) for i in range(n)]


def run(spark, ids, vectors, labels, **options):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], k) for i, v, k in zip(ids, vectors, labels, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("clash")).repartition(3)
    return sorted(tuple(r) for r in neardup.embedding_neardups(df, **options).collect())


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    v = make(rng)
    labels = [int(x) for x in rng.integers(0, 3, len(v))]
    for i in range(0, len(v), 5):
        labels[i] = labels[i - 1]
    labels[3] = labels[7] = labels[9] = 1
    ids = list(range(1000, 1000 + len(v)))
    expected = sorted(brute(ids, list(v), labels))
    assert run(spark, ids, list(v), labels) == expected
    assert run(spark, ids, list(v), labels, block=16, whole=99) == expected
    assert sum(r[1] for r in expected) > 20


def test_edge_cases(spark):
    one = [1.0] * 8
    vectors = [one, one, one, None, [0.0] * 8, [1.0, None, *one[2:]], [float("nan"), *one[1:]], [float("inf"), *one[1:]], [], [1.0] * 4, [-0.0, *one[1:]], [0.0, *one[1:]], one]
    labels = [1, 1, None, 1, 1, 1, 1, 1, 1, 1, 2, 2, 1]
    ids = list(range(len(vectors)))
    assert run(spark, ids, vectors, labels) == sorted(brute(ids, vectors, labels))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neardup.embedding_neardups(empty).count() == 0


def coded(v):
    signs, factors = zip(*[neardup.encode(v, neardup.rotation(v.shape[1], r)) for r in range(2)], strict=True)
    return neardup.Codes(np.concatenate([np.packbits(x, axis=1) for x in signs], axis=1), np.stack(factors, axis=1), v.shape[1])


def test_estimates_are_unbiased(monkeypatch):
    """Over random rotations; the scatter is what the bound is made from."""
    rng = np.random.default_rng(1)
    v = neardup.unit_rows(rng.standard_normal((40, 64)) + rng.standard_normal((40, 1)))
    true, seen = v @ v.T, []
    plain = neardup.rotation
    for seed in range(150):
        monkeypatch.setattr(neardup, "rotation", lambda dim, r, seed=seed: plain(dim, 1000 + 2 * seed + r))
        c = coded(v)
        seen.append(neardup.estimates(c, c, 0.98)[0] - true)
    off = ~np.eye(40, dtype=bool)
    total = np.mean(seen, axis=0)
    assert abs(total[off].mean()) < 0.005 and np.abs(total[off]).max() < 0.06


def test_bound_holds_at_the_threshold_and_rules_most_pairs_out():
    """No pair of cosine 0.98 among 200 000 is ruled out; of unlike ones nearly all are. In few dimensions it always holds."""
    rng = np.random.default_rng(2)
    for dim, n in ((64, 200_000), (128, 50_000), (40, 50_000), (3, 5000), (2, 5000), (1, 50)):
        u = neardup.unit_rows(rng.standard_normal((n, dim)))
        e = rng.standard_normal((n, dim))
        e = neardup.unit_rows(e - (e * u).sum(1, keepdims=True) * u) if dim > 1 else e * 0
        v = neardup.unit_rows(0.98 * u + np.sqrt(1 - 0.98**2) * e)
        a, b = coded(u), coded(v)
        for lo in range(0, n, 50):
            est, low = neardup.estimates(a[lo : lo + 50], b[lo : lo + 50], 0.98)
            assert (np.diag(est + low) >= 0.98 - neardup.SLACK).all()
    u = coded(neardup.unit_rows(rng.standard_normal((1000, 64))))
    assert len(neardup.candidates(u, u, 0.98, True)[0]) < 0.002 * 1000 * 999 / 2


def test_recall_of_bands(spark):
    """A label far above the block size: pairs meet by bands of code bits. All links of the brute force are found here."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((2000, 64))
    near = base[:700] / np.linalg.norm(base[:700], axis=1, keepdims=True)
    e = rng.standard_normal((700, 64))
    e -= (e * near).sum(1, keepdims=True) * near
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    cos = rng.uniform(0.9801, 0.9999, (700, 1))
    v = np.concatenate([base, cos * near + np.sqrt(1 - cos**2) * e, near[:1] + 0.01 * rng.standard_normal((120, 64))])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = run(spark, list(range(len(v))), [x.tolist() for x in np.float32(v)], [1] * len(v), block=32, whole=4)
    links = [r[1] for r in got]
    expected = ((unit @ unit.T) >= 0.98).sum(1) - 1
    assert sum(links) >= 0.999 * expected.sum() > 15_000 and all(a <= b + 1 for a, b in zip(links, expected, strict=True))
    assert neardup.bands_for(7, 0.98) > 5


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(50)] + [(2000, 2001 + k) for k in range(60)] + [(5, 5)]
    part = {x: x for e in edges for x in e}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        part[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in part if any(x in e and e[0] != e[1] for e in edges)}
