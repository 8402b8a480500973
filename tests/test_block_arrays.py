"""The block search over arrays against the joined steps, plain lengths and a planted graph of many small parts."""

import random
import time

import numpy as np
import pytest

from clusterloom.operators import blocksearch
from clusterloom.operators.blockarrays import Search, Units, changes
from tests.test_blocksearch import plain_length


def units_of(pairs, n, model):
    a, b = np.array(sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})).T
    k = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    one, none = np.ones(n, np.int64), np.zeros(n, np.int64)
    return Units(model, 1234, one, k, none, a, b, np.ones(len(a), np.int64), n, len(a))


def steps():
    return Search(blocksearch._prior, blocksearch.NODE_DRAWS, blocksearch.BLOCK_DRAWS, blocksearch.DIRECT)


@pytest.mark.parametrize("full", [1 << 10, 0])
@pytest.mark.parametrize("model", blocksearch.MODELS)
def test_changes_are_differences_of_plain_lengths(model, full, monkeypatch):
    """Every move of nodes, and of units with edges inside, through the full matrix and through the sorted one."""
    monkeypatch.setattr("clusterloom.operators.blockarrays.FULL", full)
    rng = random.Random(4)
    pairs = [(a, b) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.35]
    g, s = units_of(pairs, 15, model), steps()
    unit = np.array([v // 2 for v in range(15)])  # 14 has no edges and a unit of its own
    small = s.state(g, unit)
    apart = small.r < small.s
    wide = Units(model, 1, small.n, small.e, small.inner, small.r[apart], small.s[apart], small.m[apart], g.n, g.e)
    for graph, of in ((g, np.arange(15)), (wide, unit)):
        label = np.array([rng.randrange(4) for _ in graph.size])
        label[5] = 4
        state = s.state(graph, label)
        base = plain_length(pairs, dict(enumerate(state.label[of].tolist())), model)
        one = s.state(graph, np.zeros(len(label), np.int64))
        assert one.length - state.length == pytest.approx(plain_length(pairs, dict.fromkeys(range(15), 0), model) - base, abs=1e-8)
        v, t = (x.ravel() for x in np.meshgrid(np.arange(len(label)), np.arange(state.b)))
        v, t = v[state.label[v] != t], t[state.label[v] != t]
        for i, to, change in zip(v, t, changes(graph, state, v, t, blocksearch._prior), strict=True):
            after = state.label.copy()
            after[i] = to
            assert plain_length(pairs, dict(enumerate(after[of].tolist())), model) - base == pytest.approx(change, abs=1e-8)


@pytest.mark.parametrize("model", blocksearch.MODELS)
def test_many_small_parts_are_searched_in_seconds(model):
    """Forty thousand edges in parts of a few nodes, as at 0.1 GB, which joined rounds did not finish in 1,200 s."""
    rng = np.random.default_rng(3)
    a = np.arange(50_000)
    pairs = list(zip(a.tolist(), (a - a % 8 + rng.integers(0, 8, len(a))).tolist(), strict=True))
    g, began = units_of(pairs, 50_000, model), time.perf_counter()
    label = blocksearch.searched(g, [np.zeros(50_000, np.int64), np.arange(50_000) // 8])
    assert time.perf_counter() - began < 300
    s = steps()
    assert s.state(g, label).length <= min(s.state(g, x).length for x in (np.zeros(50_000, np.int64), np.arange(50_000) // 8))


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_a_matrix_too_large_for_a_task_is_merged_first(spark, limit, monkeypatch):
    """Two sides of a bipartite graph are found in a task, and with the limit below the graph's edges."""
    monkeypatch.setattr(blocksearch, "IN_TASK_EDGES", limit)
    rng = random.Random(1)
    pairs = [(a, 16 + b) for a in range(16) for b in range(16) if rng.random() < 0.6]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    label = {r["node_id"]: r["cluster_id"] for r in blocksearch.search(edges, "dc").collect()}
    assert plain_length(pairs, label, "dc") <= plain_length(pairs, dict.fromkeys(range(32), 0), "dc") + 1e-9
    if limit > len(pairs):
        assert plain_length(pairs, label, "dc") == pytest.approx(plain_length(pairs, {v: v // 16 for v in range(32)}, "dc"), abs=1e-6)
