import numpy as np
import pytest

from snapcat.llm.components import connected_components


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(chain, rounds=1)
    assert {(r.node, r.component) for r in connected_components(chain).collect()} == {(i, 0) for i in range(41)}
    assert connected_components(chain.limit(0)).count() == 0


def test_long_path_and_tree(spark):
    """A path of 5 000 edges under shuffled numbers, a deep random tree and a star, against a plain search."""
    rng = np.random.default_rng(0)
    name = rng.permutation(20_000).tolist()
    edges = [(name[i], name[i + 1]) for i in range(5000)]
    edges += [(name[6000 + i], name[6000 + int(rng.integers(max(0, i - 3), i))]) for i in range(1, 1500)] + [(name[9000], name[9001 + i]) for i in range(900)]
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    expected = {}
    for n in sorted(near):
        todo = [] if n in expected else [n]
        while todo:
            x = todo.pop()
            if x not in expected:
                expected[x] = n
                todo += near[x]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == expected
