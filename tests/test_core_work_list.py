"""Core numbers by the work list, and cores taken off one after the other, against plain peeling."""

import random

import pytest
from pyspark.sql import functions as F

from clusterloom.operators import kcore


def plain_cores(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    degree = {v: len(x) for v, x in near.items()}
    core, level = {}, 0
    while degree:
        v = min(degree, key=degree.get)
        level = max(level, degree.pop(v))
        core[v] = level
        for u in near[v]:
            if u in degree:
                degree[u] -= 1
    return core


def plain_levels(edges, k):
    """{node: core when it was taken off} of all clusters, lone nodes cannot occur."""
    found, left = {}, [e for e in edges if e[0] != e[1]]
    while cores := plain_cores(left):
        top = max(cores.values())
        if top < max(k, 1):
            break
        inner = {v for v, c in cores.items() if c == top}
        found |= dict.fromkeys(inner, top)
        left = [e for e in left if not inner & set(e)]
    return found


def graph_of(seed):
    """Dense groups of unequal size with parallel edges, loose links between them, and chains that hang on."""
    rng = random.Random(seed)
    edges, at = [], 0
    for size, share in ((12, 0.9), (9, 0.8), (15, 0.5), (20, 0.25)):
        edges += [(a, b) for a in range(at, at + size) for b in range(a + 1, at + size) if rng.random() < share]
        at += size
    edges += [(rng.randrange(at), rng.randrange(at)) for _ in range(90)] + rng.sample(edges, 10)
    for _ in range(4):
        edges.append((rng.randrange(at), at))
        edges += [(at + i, at + i + 1) for i in range(6)]
        at += 7
    return edges


@pytest.mark.parametrize("seed", [2])
def test_levels_equal_plain_peeling(spark, seed):
    edges = graph_of(seed)
    table = spark.createDataFrame(edges, "src long, dst long")
    found = {r["node_id"]: r["k"] for r in kcore.iterative_k_core(table, 2).collect()}
    assert found == plain_levels(edges, 2)


def test_starting_from_earlier_cores_after_links_went(spark):
    edges = graph_of(3)
    cores = plain_cores(edges)
    gone = {v for v, c in cores.items() if c == max(cores.values())}
    left = [e for e in edges if not gone & set(e)]
    upper = spark.createDataFrame(list(cores.items()), "node long, most long")
    touched = spark.createDataFrame([(v,) for v in {v for e in edges if gone & set(e) for v in e} - gone], "node long")
    table = spark.createDataFrame(left, "src long, dst long")
    for start in ({}, {"upper": upper}, {"upper": upper, "touched": touched}):
        found = {r["node"]: r["core"] for r in kcore.core_numbers(table, **start).where(F.col("core") > 0).collect()}
        assert found == plain_cores(left)
