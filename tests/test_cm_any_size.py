"""CM cuts at the most even minimum cut and clusters both sides anew, whatever the cluster's size."""

import random
from itertools import combinations

import numpy as np

from clusterloom.operators import localmove, refine


def drawn(rng, n, p):
    return sorted({(rng.randrange(i), i) for i in range(1, n)} | {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p})


def test_even_cut_is_the_most_even_and_ties_fall_by_the_least_nodes():
    rng = random.Random(5)
    for _ in range(120):
        n = rng.randint(4, 9)
        pairs = drawn(rng, n, rng.random() * 0.6)
        a, b = np.array(pairs).T
        sides = [set(s) for k in range(1, n) for s in combinations(range(1, n), k)]
        cut = {frozenset(s): sum((x in s) != (y in s) for x, y in pairs) for s in sides}
        value = min(cut.values())
        want = min((s for s in cut if cut[s] == value), key=lambda s: (-min(len(s), n - len(s)), sorted(s)))
        assert set(np.flatnonzero(refine.even_cut(a, b, n, value)).tolist()) == want


def groups(spark, edges, clustering, **more):
    found = {}
    for r in localmove.modified_clusters(edges, clustering, "1.5", **more).collect():
        found.setdefault(r["cluster_id"], set()).add(r["node_id"])
    return sorted(map(sorted, found.values()))


def test_the_same_pieces_whatever_a_task_holds(spark, monkeypatch):
    """Two dense groups of each half hang together by many edges; only clustering the halves anew tells them apart."""
    rng, pairs = random.Random(3), []
    for half in (0, 40):
        for g in (0, 12):
            pairs += [(half + g + x, half + g + y) for x in range(12) for y in range(x + 1, 12) if rng.random() < 0.9]
        pairs += [(half + i, half + 12 + i) for i in range(4)]
    pairs.append((0, 40))
    edges = spark.createDataFrame(pairs, "src long, dst long")
    clustering = spark.createDataFrame([(v, 0) for e in pairs for v in e], "node_id long, cluster_id long").distinct()
    whole = groups(spark, edges, clustering)
    assert whole == [[*range(c, c + 12)] for c in (0, 12, 40, 52)]
    monkeypatch.setattr(refine, "ONCE_EDGES", 10)
    assert groups(spark, edges, clustering) == whole
    monkeypatch.setattr(refine, "IN_TASK_EDGES", 200)  # the cluster fits no task, its halves do
    assert groups(spark, edges, clustering) == whole
