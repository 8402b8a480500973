"""Nested fits of a graph that a task holds need no joined rounds of the search."""

import random

from clusterloom.operators import blockmodel, blocksearch


def test_nested_fit_makes_no_joined_state(spark, monkeypatch):
    monkeypatch.delattr(blocksearch, "state_of")
    rng = random.Random(2)
    pairs = [(a, 10 + b) for a in range(10) for b in range(10) if rng.random() < 0.7]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    one = spark.createDataFrame([(v, "all") for v in range(20)], "node_id long, cluster_id string")
    levels, length = blockmodel.nested_blocks(edges, "dc", tried=[one])
    assert length <= blockmodel.description_length(edges, one, "dc").first()["entropy"] + 1e-9
    assert sorted(r["node_id"] for r in levels[0].collect()) == list(range(20))
