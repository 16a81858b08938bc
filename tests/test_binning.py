import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snapcat.plans import binning


def slow_next_fit(costs, target):
    out, bins, used, is_open = [], 0, 0, False
    for c in costs:
        if c > target:
            bins, is_open = bins + 1, False
        elif not is_open or used + c > target:
            bins, used, is_open = bins + 1, c, True
        else:
            used += c
        out.append(bins - 1)
    return out


def slow_ffd(costs, target):
    rooms, out = [], [None] * len(costs)
    for i in sorted(range(len(costs)), key=lambda k: (-costs[k], k)):
        c = costs[i]
        b = next((k for k, r in enumerate(rooms) if c <= target and r >= c), None)
        if b is None:
            rooms.append(max(target - c, 0))
            b = len(rooms) - 1
        else:
            rooms[b] -= c
        out[i] = b
    return out


@pytest.mark.parametrize(("costs", "bins"), [([], []), ([50], [0]), ([40] * 4, [0, 0, 1, 1]), ([30, 150, 30], [0, 1, 2]), ([60, 40], [0, 0])])
def test_next_fit_vectors(costs, bins):
    assert binning.NextFit(100).assign(np.array(costs, np.int64)).tolist() == bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 140), max_size=80), st.integers(1, 100), st.integers(0, 80))
def test_next_fit_in_batches(costs, target, cut):
    state = binning.NextFit(target)
    got = [*state.assign(np.array(costs[:cut], np.int64)), *state.assign(np.array(costs[cut:], np.int64))]
    assert got == slow_next_fit(costs, target)


def from_runs(costs, target):
    values, counts = np.unique(np.array(costs, np.int64), return_counts=True)
    bins = {c: [None] * n for c, n in zip(values.tolist(), counts.tolist(), strict=True)}
    for c, a, b, k in binning.ffd_runs(values.tolist(), counts.tolist(), target):
        bins[c][a:b] = [k] * (b - a)
    seen = dict.fromkeys(bins, 0)
    out = []
    for c in costs:
        out.append(bins[c][seen[c]])
        seen[c] += 1
    return out


@pytest.mark.parametrize(("costs", "bins"), [([], []), ([50], [0]), ([20, 90, 30, 50], [1, 0, 1, 1]), ([30, 150, 30], [1, 0, 1])])
def test_ffd_vectors(costs, bins):
    assert from_runs(costs, 100) == bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 140), max_size=80), st.integers(1, 100))
def test_ffd(costs, target):
    assert from_runs(costs, target) == slow_ffd(costs, target)


@pytest.mark.parametrize("algorithm", ["next-fit", "ffd"])
def test_classes(spark, algorithm):
    rng = np.random.default_rng(3)
    rows = [(i, int(c), "store" if i % 3 == 0 else "normal") for i, c in enumerate(rng.integers(1, 130, 300))]
    df = spark.createDataFrame(rows, "seq long, cost long, cls string").repartition(7)
    got = {r.seq: r.bin for r in binning.bins_by_class(df, 100, algorithm).collect()}
    slow = {"next-fit": slow_next_fit, "ffd": slow_ffd}[algorithm]
    shift, expected = 0, {}
    for cls in ("normal", "store"):
        own = [(i, c) for i, c, k in rows if k == cls]
        bins = slow([c for _, c in own], 100)
        expected |= {i: b + shift for (i, _), b in zip(own, bins, strict=True)}
        shift += max(bins) + 1
    assert got == expected


def test_target_must_be_positive(spark):
    df = spark.createDataFrame([], "seq long, cost long, cls string")
    for f in (binning.bins_next_fit, binning.bins_ffd):
        with pytest.raises(ValueError, match="positive"):
            f(df, 0)
    assert binning.bins_by_class(df, 10).count() == 0
