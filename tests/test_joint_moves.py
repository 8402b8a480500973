"""Large levels, where nodes that are judged together move at once, and the size of component that a task holds."""

import numpy as np
import pytest

from clusterloom.operators import localmove, movearrays


def planted(n=3000, groups=10, inner=30, outer=10):
    rng = np.random.default_rng(4)
    a = rng.integers(0, n, n * (inner + outer) // 2)
    near = (a + groups * rng.integers(1, n // groups, len(a))) % n
    b = np.where(rng.random(len(a)) < inner / (inner + outer), near, rng.integers(0, n, len(a)))
    pairs = np.unique(np.sort(np.stack([a, b], axis=1)[a != b], axis=1), axis=0)
    return pairs.T


@pytest.mark.parametrize("model", localmove.MODELS)
def test_joint_moves_find_planted_groups(model, monkeypatch):
    a, b = planted()
    n, gamma = 3000, 0.02 if model == "cpm" else 1.0
    find = lambda: localmove.cluster_arrays(a, b, np.ones(len(a)), np.zeros(n), np.ones(n, np.int64), model, gamma, float(len(a)), 7)
    for along in (movearrays.ALONG, n + 1):  # joint moves, and none
        monkeypatch.setattr(movearrays, "ALONG", along)
        label = find()
        assert len(np.unique(label)) == 10
        assert np.mean([len(np.unique(label[g::10])) for g in range(10)]) == 1


def test_six_copies_of_the_whole_graph_fit_a_task():
    assert localmove.IN_TASK_EDGES >= 6 * 1_196_000
