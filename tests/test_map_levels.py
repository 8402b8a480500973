"""The map equation over levels of modules against its plain form."""

import math
import random

import pytest

from clusterloom.operators import localmove


def plogp(x):
    return x * math.log2(x) if x > 0 else 0.0


def code_length(pairs, paths):
    """Bits a step of a walk on a graph of unit weights costs; ``paths``: each node's modules, the outermost first."""
    m = len(pairs)
    visit, leave, children = {}, {}, {}
    for a, b in pairs:
        for v in (a, b):
            visit[v] = visit.get(v, 0) + 1 / (2 * m)
        for v, w in ((a, b), (b, a)):
            for i in range(1, len(paths[v]) + 1):
                module = paths[v][:i]
                leave[module] = leave.get(module, 0) + (paths[w][:i] != module) / (2 * m)
    for module in leave:
        children.setdefault(module[:-1], set()).add(module)
    total = 0.0
    for book, inner in children.items():
        rates = [leave[x] for x in inner] + [leave.get(book, 0.0)]
        total += plogp(sum(rates)) - sum(map(plogp, rates))
    for leaf in set(paths.values()):
        rates = [p for v, p in visit.items() if paths[v] == leaf] + [leave[leaf]]
        total += plogp(sum(rates)) - sum(map(plogp, rates))
    return total


def paths_of(levels):
    paths = {}
    for level in reversed(levels):
        for r in level.collect():
            paths[r["node_id"]] = (*paths.get(r["node_id"], ()), r["piece"])
    return paths


def test_two_planted_levels_are_found_and_coded_more_shortly(spark):
    """Four groups of four rings of cliques: the walk seldom leaves a group, and within it often a clique."""
    rng = random.Random(2)
    node = lambda g, c, i: 100 * g + 10 * c + i
    pairs = {(node(g, c, i), node(g, c, j)) for g in range(6) for c in range(6) for i in range(6) for j in range(i)}
    pairs |= {tuple(sorted((node(g, c, rng.randrange(6)), node(g, d, rng.randrange(6))))) for g in range(6) for c in range(6) for d in range(c) for _ in range(2)}
    pairs |= {tuple(sorted((node(g, 0, 0), node((g + 1) % 6, 1, 1)))) for g in range(6)}
    pairs = sorted(pairs)
    levels, length = localmove.map_levels(spark.createDataFrame(pairs, "src long, dst long"))
    paths = paths_of(levels)
    assert len(levels) == 2 and length == pytest.approx(code_length(pairs, paths), abs=1e-9)
    assert {frozenset(v for v in paths if paths[v][0] == p[0]) for p in paths.values()} == {frozenset(node(g, c, i) for c in range(6) for i in range(6)) for g in range(6)}
    assert {frozenset(v for v in paths if paths[v] == p) for p in paths.values()} == {frozenset(node(g, c, i) for i in range(6)) for g in range(6) for c in range(6)}
    assert length < code_length(pairs, {v: p[1:] for v, p in paths.items()}) - 0.01


def test_separate_parts_and_an_empty_graph(spark):
    pairs = [(10 * g + i, 10 * g + j) for g in range(3) for i in range(4) for j in range(i)]
    levels, length = localmove.map_levels(spark.createDataFrame(pairs, "src long, dst long"))
    paths = paths_of(levels)
    assert len(levels) == 1 and len(set(paths.values())) == 3 and length == pytest.approx(code_length(pairs, paths), abs=1e-9)
    levels, length = localmove.map_levels(spark.createDataFrame([], "src long, dst long"))
    assert levels[0].count() == 0 and length == 0
