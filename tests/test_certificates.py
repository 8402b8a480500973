"""Sparse certificates and cuts of clusters that do not fit a task, against all subsets of small graphs."""

import random
from itertools import combinations

import pytest

from clusterloom.operators import refine


def cut_of(pairs, side):
    return sum((a in side) != (b in side) for a, b in pairs)


def sides(nodes):
    nodes = sorted(nodes)
    return [set(c) | {nodes[0]} for r in range(len(nodes) - 1) for c in combinations(nodes[1:], r)]


def random_graph(rng, n, p):
    return sorted({(rng.randrange(i), i) for i in range(1, n)} | {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p})


def test_forests_keep_small_cuts_and_their_last_trees_are_never_parted():
    rng = random.Random(7)
    for _ in range(60):
        n, k = rng.randint(2, 9), rng.randint(1, 5)
        pairs = random_graph(rng, n, rng.random())
        level, tree = refine.forest_levels([a for a, _ in pairs], [b for _, b in pairs], n, k)
        kept = [p for p, x in zip(pairs, level) if x < k]
        assert len(kept) <= k * (n - 1)
        for side in sides(range(n)):
            if len(side) < n:
                whole = cut_of(pairs, side)
                assert min(whole, k) <= cut_of(kept, side) <= whole
                if whole < k:
                    assert all((a in side) == (b in side) for a in range(n) for b in range(a) if tree[a] == tree[b])


def test_parts_hang_on_few_edges():
    """Every part is cut off by at most f(n) edges, and one part means that no cut is as small."""
    rng = random.Random(8)
    for _ in range(80):
        n, c = rng.randint(3, 9), rng.choice([1, 1.5, 2, 3])
        pairs = random_graph(rng, n, rng.random())
        part = refine.split_of([a for a, _ in pairs], [b for _, b in pairs], n, int(c) + 1, str(c))
        least = min(cut_of(pairs, s) for s in sides(range(n)) if len(s) < n)
        assert (max(part) == 0) == (least > c)
        for p in set(part) - {0}:
            assert cut_of(pairs, {v for v in range(n) if part[v] == p}) <= c


@pytest.mark.parametrize("limit", [7])
def test_clusters_beyond_a_task_end_well_connected(spark, monkeypatch, limit):
    monkeypatch.setattr(refine, "IN_TASK_EDGES", limit)
    rng = random.Random(limit)
    pairs, clusters = [], {}
    for c in range(4):
        dense = [(20 * c + 5 * g + a, 20 * c + 5 * g + b) for g in range(3) for a in range(5) for b in range(a) if rng.random() < 0.9]
        loose = [(20 * c + 4, 20 * c + 5), (20 * c + 9, 20 * c + 10), (20 * c + 8, 20 * c + 11), (20 * c + 14, 20 * c + 15)]
        pairs += dense + loose
        clusters |= dict.fromkeys(range(20 * c, 20 * c + 17), c)
    pairs += [(3, 23), (24, 44)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    clustering = spark.createDataFrame([*clusters.items()], "node_id long, cluster_id long")
    got = {}
    for r in refine.well_connected_clusters(edges, clustering, "1.5").collect():
        got.setdefault(r["cluster_id"], set()).add(r["node_id"])
    assert got and sorted(got) == list(range(len(got)))
    for nodes in got.values():
        own = [p for p in pairs if set(p) <= nodes]
        assert len({clusters[v] for v in nodes}) == 1 and min(cut_of(own, s) for s in sides(nodes) if len(s) < len(nodes)) > 1.5
    assert sum(map(len, got.values())) >= 40  # the dense groups are left
    cuts = {r["cluster_id"]: r["min_cut"] for r in refine.cluster_cuts(edges, clustering).collect()}
    for c in range(4):
        nodes = {v for v, x in clusters.items() if x == c}
        own = [p for p in pairs if set(p) <= nodes]
        touched = {v for p in own for v in p}
        want = 0.0 if touched != nodes else min(cut_of(own, s) for s in sides(nodes) if len(s) < len(nodes))
        assert cuts[c] == want


def test_certificate_of_many_chunks_keeps_small_cuts(spark, monkeypatch):
    monkeypatch.setattr(refine, "IN_TASK_EDGES", 6)
    rng = random.Random(3)
    graphs = {c: random_graph(rng, 8, 0.8) for c in range(3)}
    links = spark.createDataFrame([(c, a, b, 3) for c, pairs in graphs.items() for a, b in pairs], "cluster_id long, src long, dst long, k int")
    rows = refine.sparse_certificate(links).collect()
    for c, pairs in graphs.items():
        kept = [(r["src"], r["dst"]) for r in rows if r["cluster_id"] == c]
        assert set(kept) <= set(pairs) and len(kept) == len(set(kept))
        assert all(min(cut_of(pairs, s), 3) <= cut_of(kept, s) for s in sides(range(8)) if len(s) < 8)
