"""Queries over pairs that are known to be simple do not tell them apart once more, and make them once."""

import random

import pytest

from clusterloom.functions import measures
from clusterloom.operators import blockmodel
from clusterloom.plans import queries


def drawn(spark, seed=5, n=30):
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.15]
    clustering = spark.createDataFrame([(v, v % 4) for v in range(n) if v % 7], "node_id long, cluster_id long")
    return spark.createDataFrame(pairs, "src long, dst long"), clustering


@pytest.mark.parametrize("measure", ["cluster_stats", "coverage", "cluster_components", "cpm_score"])
def test_measures_of_known_pairs(spark, measure, monkeypatch):
    edges, clustering = drawn(spark)
    more = (0.1,) if measure == "cpm_score" else ()
    of = getattr(measures, measure)
    want = sorted(map(tuple, of(edges.unionByName(edges.selectExpr("dst AS src", "src AS dst")), clustering, *more).collect()))
    monkeypatch.delattr(measures, "profile")  # the distinct over a split of pairs was the largest task
    assert sorted(map(tuple, of(edges, clustering, *more, simple=True).collect())) == want


def test_description_lengths_of_known_pairs(spark, monkeypatch):
    edges, clustering = drawn(spark)
    want = {r["model"]: r["entropy"] for r in blockmodel.description_lengths(edges, clustering).collect()}
    monkeypatch.delattr(blockmodel, "profile")
    found = {r["model"]: r["entropy"] for r in blockmodel.description_lengths(edges, clustering, known_simple=True).collect()}
    assert found == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("name", ["coverage_some", "accuracy"])
def test_pairs_are_made_once_and_nodes_are_written(spark, name, monkeypatch):
    edges, clustering = drawn(spark)
    made, written = [], []
    monkeypatch.setattr(queries, "by_brand", lambda s, d: clustering)
    monkeypatch.setattr(queries, "stored", lambda df: written.append(df.columns) or df)

    def copart(s, d):
        made.append(d)
        return edges

    assert queries._queries(copart, copart, copart, "true")[name](spark, "").count() > 0
    assert len(made) == 1
    assert name != "accuracy" or written == [["node"]]
