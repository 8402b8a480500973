"""Local moves over arrays against those over maps of neighbours, and components that share a bin."""

import numpy as np
import pytest

from clusterloom.operators import localmove
from clusterloom.operators.movearrays import move_arrays


def drawn(seed, n=60, groups=5):
    """Weighted pairs with denser groups, no pair twice."""
    rng = np.random.default_rng(seed)
    a, b = np.triu_indices(n, 1)
    kept = rng.random(len(a)) < np.where(a % groups == b % groups, 0.6, 0.1)
    return a[kept], b[kept], rng.integers(1, 4, kept.sum()).astype(float)


@pytest.mark.parametrize("model", localmove.MODELS)
@pytest.mark.parametrize("seed", range(6))
def test_arrays_make_the_moves_of_maps(model, seed):
    a, b, w = drawn(seed)
    n, gamma, m = 60, 0.3 if model == "cpm" else 1.0, float(w.sum())
    links = [{} for _ in range(n)]
    for x, y, z in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        links[x][y] = links[y][x] = z
    loops, sizes = np.arange(n) % 3.0, np.arange(n) % 2 + 1
    rest = (model, gamma, m, seed)
    want = localmove.move_nodes(links, loops.tolist(), sizes.tolist(), *rest, elsewhere=5.0)
    got = move_arrays(a, b, w, loops, sizes, *rest, elsewhere=5.0)
    assert got.tolist() == want
    bounds = np.unique(got, return_inverse=True)[1]
    assert move_arrays(a, b, w, loops, sizes, *rest, bounds=bounds).tolist() == localmove.move_nodes(links, loops.tolist(), sizes.tolist(), *rest, bounds=bounds.tolist())


@pytest.mark.parametrize("model", localmove.MODELS)
def test_components_share_bins_and_keep_their_clusters(spark, model, monkeypatch):
    """The clusters do not depend on the components that share a bin."""
    rows = [(100 * c + int(x), 100 * c + int(y), float(z)) for c in range(8) for x, y, z in zip(*drawn(c, 20, 3), strict=True)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    ready = localmove.prepared(edges)
    together = sorted(map(tuple, localmove.local_labels(ready, model, 0.5).collect()))
    assert localmove._binned(ready[0])[0].select("bin").distinct().count() == 1
    monkeypatch.setattr(localmove, "MOVE_BIN_EDGES", 1)
    assert localmove._binned(ready[0])[0].select("bin").distinct().count() == 8
    assert sorted(map(tuple, localmove.local_labels(ready, model, 0.5).collect())) == together


def test_a_whole_component_of_a_million_edges_fits_a_task():
    """Nodes with a hundred neighbours: a level takes seconds over arrays, and a component of sf0.1's whole graph goes to one task."""
    assert localmove.IN_TASK_EDGES >= 1_200_000
    rng = np.random.default_rng(1)
    pairs = np.unique(np.sort(rng.integers(0, 2000, (100_000, 2)), axis=1), axis=0)
    a, b = pairs[pairs[:, 0] != pairs[:, 1]].T
    label = localmove.cluster_arrays(a, b, np.ones(len(a)), np.zeros(2000), np.ones(2000, np.int64), "mod", 1.0, float(len(a)), 7)
    inner = label[a] == label[b]
    degree = np.bincount(a, minlength=2000) + np.bincount(b, minlength=2000)
    value = inner.mean() - (np.bincount(label, degree) ** 2).sum() / (2 * len(a)) ** 2
    assert value > 0.05 and len(set(label.tolist())) > 2
