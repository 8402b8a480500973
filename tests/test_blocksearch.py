"""The search of block models against a plain description length, and on planted graphs."""

import math
import random

import pytest

from clusterloom.operators import blockmodel, blocksearch

lf = lambda n: math.lgamma(n + 1)
choose = lambda n, k: lf(n) - lf(k) - lf(n - k) if 0 < k < n else 0.0


def plain_length(pairs, label, model):
    """The description length of a partition {node: block} of a simple graph."""
    cells, e, n, k = {}, {}, {}, {}
    for v, r in label.items():
        n[r] = n.get(r, 0) + 1
        e.setdefault(r, 0)
    for a, b in {(min(p), max(p)) for p in pairs if p[0] != p[1]}:
        for v in (a, b):
            k[v] = k.get(v, 0) + 1
            e[label[v]] += 1
        cell = tuple(sorted((label[a], label[b])))
        cells[cell] = cells.get(cell, 0) + 1
    edges, nodes, blocks = sum(cells.values()), len(label), len(n)
    inner = sum(m for (r, s), m in cells.items() if r == s)
    matrix = sum(lf(m) + (m * math.log(2) if r == s else 0) for (r, s), m in cells.items())
    prior = sum(lf(x) for x in n.values()) - lf(nodes) - choose(nodes - 1, blocks - 1) - math.log(nodes)
    cells_prior = choose(blocks * (blocks + 1) // 2 + edges - 1, edges)
    if model == "dc":
        fit = matrix + sum(map(lf, k.values())) - sum(map(lf, e.values())) - cells_prior - sum(choose(n[r] + e[r] - 1, e[r]) for r in n)
    elif model == "ndc":
        fit = matrix - sum(e[r] * math.log(n[r]) for r in n) - cells_prior
    else:
        out = edges - inner
        across = out * math.log(blocks * (blocks - 1) / 2) + math.log(edges + 1) if blocks > 1 else 0.0
        fit = lf(inner) + lf(out) - inner * math.log(blocks / 2) - across + sum(lf(n[r] - 1) - lf(e[r] + n[r] - 1) for r in n) + sum(map(lf, k.values()))
    return -fit - prior


@pytest.mark.parametrize("model", blocksearch.MODELS)
def test_changes_are_differences_of_lengths(spark, model):
    """Every move and every merge of a small graph with an isolated node and a block of one."""
    rng = random.Random(4)
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.35] + [(12, 12)]
    label = {v: rng.randrange(4) for v in range(13)} | {5: 9}
    g, ids = blocksearch.simple_graph(spark.createDataFrame(pairs, "src long, dst long"), model)
    name = {r["node"]: r["node_id"] for r in ids.collect()}
    s = blocksearch.state_of(g, spark.createDataFrame([(i, label[v]) for i, v in name.items()], "node long, block long"))
    base, blocks = plain_length(pairs, label, model), sorted(set(label.values()))
    fixed = base - s.length  # what the graph alone adds
    moves = blocksearch.move_changes(g, s, spark.createDataFrame([(i, b) for i in name for b in blocks], "node long, t long")).collect()
    assert len(moves) == 13 * (len(blocks) - 1)
    for r in moves:
        assert plain_length(pairs, label | {name[r["node"]]: r["t"]}, model) - base == pytest.approx(r["change"], abs=1e-8)
    merges = blocksearch.merge_changes(g, s, spark.createDataFrame([(a, b) for a in blocks for b in blocks if a != b], "r long, t long")).collect()
    assert len(merges) == len(blocks) * (len(blocks) - 1)
    for r in merges:
        after = {v: r["t"] if b == r["r"] else b for v, b in label.items()}
        assert plain_length(pairs, after, model) - base == pytest.approx(r["change"], abs=1e-8)
    one = blocksearch.state_of(g, g.nodes.selectExpr("node", "0L AS block"))
    assert one.length + fixed == pytest.approx(plain_length(pairs, dict.fromkeys(label, 0), model), abs=1e-8)


def test_a_round_of_moves_never_lengthens(spark):
    rng = random.Random(9)
    pairs = [(a, b) for a in range(24) for b in range(a) if rng.random() < (0.7 if a % 3 == b % 3 else 0.1)]
    g, _ = blocksearch.simple_graph(spark.createDataFrame(pairs, "src long, dst long"), "dc")
    s = blocksearch.state_of(g, g.nodes.selectExpr("node", "pmod(xxhash64(node), 5) AS block"))
    for i in range(3):
        step = blocksearch.moved(g, s, i)
        assert step is None or step.length < s.length
        s = step or s


def test_blocks_without_edges_inside_are_found(spark):
    """Two sides of a bipartite graph: no partition by density of edges inside comes near them."""
    rng = random.Random(1)
    pairs = [(a, 16 + b) for a in range(16) for b in range(16) if rng.random() < 0.6]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    alone = spark.createDataFrame([(v, str(v)) for v in range(32)], "node_id long, cluster_id string")
    blocks, length = blockmodel.fit_blocks(edges, "dc", tried=[alone.withColumn("cluster_id", alone.cluster_id * 0)])
    sides = {}
    for r in blocks.collect():
        sides.setdefault(r["cluster_id"], set()).add(r["node_id"])
    assert sorted(map(min, sides.values())) == [0, 16] and sorted(map(len, sides.values())) == [16, 16]
    assert length == pytest.approx(plain_length(pairs, {v: v // 16 for v in range(32)}, "dc"), abs=1e-6)


def test_empty_graph_and_unknown_model(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert blocksearch.search(none, "dc").count() == 0
    with pytest.raises(ValueError):
        blocksearch.search(none, "other")
