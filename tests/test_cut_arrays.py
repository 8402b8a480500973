"""Minimum cuts over arrays of edges: what they hold, and parts that are apart."""

import random
import tracemalloc

import numpy as np

from clusterloom.operators import refine


def test_edges_are_held_in_arrays():
    draw, n = random.Random(1), 400
    pairs = sorted({(a, b) for a, b in ((draw.randrange(n), draw.randrange(n)) for _ in range(60_000)) if a < b})
    a, b = np.array(pairs).T
    tracemalloc.start()
    cut, side = refine.edges_cut(a, b, np.ones(len(a)), n)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cut == np.bincount(np.concatenate([a, b])).min() and len(side) in (1, n - 1)
    assert most < 300 * len(pairs)  # 240 bytes an edge; with maps of neighbours 347, and the maps themselves


def test_parts_that_are_apart_have_cut_nothing():
    assert refine.edges_cut(np.array([0, 2]), np.array([1, 3]), np.ones(2), 4)[0] == 0
    assert refine.edges_cut(np.array([], int), np.array([], int), np.ones(0), 1)[0] == np.inf
