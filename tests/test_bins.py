"""Cores in bins of components against the joined rounds and plain peeling."""

import random
from collections import Counter

import pandas as pd
import pytest

from clusterloom.operators import bins, kcore


def mixed_edges(seed):
    """Components of many sizes: cliques, paths, a random graph with parallel edges, loops."""
    draw = random.Random(seed)
    edges = [(1000 + i, 1000 + i + 1) for i in range(40)] + [(a, b) for a in range(2000, 2007) for b in range(2000, a)] + [(3000, 3001)] * 3
    edges += [(draw.randrange(60), draw.randrange(60)) for _ in range(200)] + [(5000, 5000), (2001, 2001)]
    return edges + [(6000 + 10 * i + a, 6000 + 10 * i + b) for i in range(20) for a in range(4) for b in range(a)]


def plain_cores(edges):
    left, core, k = [e for e in edges if e[0] != e[1]], {v: 0 for e in edges for v in e}, 0
    while left:
        degree = Counter(v for e in left for v in e)
        k = max(k, min(degree.values()))
        gone = {v for v, d in degree.items() if d <= k}
        gone |= {v for v in degree if all(gone & set(e) for e in left if v in e)}  # nothing left beside it
        core.update(dict.fromkeys(gone, k))
        left = [e for e in left if not gone & set(e)]
    return core


def plain_levels(edges, k):
    found, left = {}, [e for e in edges if e[0] != e[1]]
    while left:
        core = plain_cores(left)
        top = max(core.values())
        if top < max(k, 1):
            break
        inner = {v for v, c in core.items() if c == top}
        found.update(dict.fromkeys(inner, top))
        left = [e for e in left if not inner & set(e)]
    return found


@pytest.mark.parametrize("most", [10_000, 100])
def test_bins_equal_plain_peeling(spark, monkeypatch, most):
    edges = mixed_edges(most)
    monkeypatch.setattr(kcore, "IN_TASK_EDGES", most)  # the random graph's component goes by joins at 100
    monkeypatch.setattr(bins, "BIN_EDGES", 50)
    assert {r["node"]: r["core"] for r in kcore.core_numbers(spark.createDataFrame(edges, "src long, dst long")).collect()} == plain_cores(edges)


@pytest.mark.parametrize("k", [0, 2, 3])
def test_levels_of_a_bin_equal_plain_peeling(k):
    edges = [e for e in mixed_edges(k) if e[0] != e[1]]
    names, a, b = bins.numbered_ends(pd.DataFrame(edges, columns=["src", "dst"]))
    at, part, core = bins.innermost_parts(a, b, len(names), k)
    assert dict(zip(names[at].tolist(), core.tolist(), strict=True)) == plain_levels(edges, k)
    together = bins.roots(a, b, len(names))
    assert (together[at] == together[part]).all() and (part <= at).all()


def test_joined_rounds_are_left_to_large_components(spark, monkeypatch):
    monkeypatch.setattr(kcore, "_joined_cores", None)  # took a round of joins over all links for each step of every value
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    assert {r["core"] for r in kcore.core_numbers(edges).collect()} == {1}
