"""Cores by rounds that hold all nodes' values in every task, against peeling."""

import random

import numpy as np
import pytest

from clusterloom.operators import bins, kcore


def drawn(seed, n=60, m=400):
    rng = random.Random(seed)
    return [(a * 3, b * 3) for a, b in ((rng.randrange(n), int(n * rng.random() ** 2)) for _ in range(m)) if a != b]


def test_only_values_above_their_neighbours_fall():
    first, near, own = np.array([0, 3, 4, 6]), np.array([1, 2, 3, 0, 0, 3]), np.array([0, 1, 2])
    at, new = kcore.fallen(first, near, own, np.array([3, 1, 2, 5]))
    assert at.tolist() == [0] and new.tolist() == [2]


@pytest.mark.parametrize("seed", [1, 2])
def test_held_rounds_equal_peeling(spark, monkeypatch, seed):
    """Without joined rounds of a graph that no task holds."""
    monkeypatch.setattr(kcore, "IN_TASK_EDGES", 50)
    monkeypatch.setattr(kcore, "_h_index", None)
    pairs = drawn(seed)
    names, places = np.unique(np.array(pairs), return_inverse=True)
    a, b = places.reshape(-1, 2).T
    edges = spark.createDataFrame([*pairs, (3, 3), (999, 999)], "src long, dst long")
    got = {r["node"]: r["core"] for r in kcore.core_numbers(edges).collect()}
    assert got == dict(zip(names.tolist(), bins.peel(a, b, len(names)).tolist(), strict=True)) | {999: 0}
    at, part, core = bins.innermost_parts(a, b, len(names), 1)
    want = {(int(names[i]), int(k)) for i, k in zip(at, core, strict=True) if (part == part[list(at).index(i)]).sum() > 1}
    assert {(r["node_id"], r["k"]) for r in kcore.iterative_k_core(edges, 1).collect()} == want
