"""Micro graphs with answers worked out by hand."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clusterloom.functions import measures
from clusterloom.functions.logmath import log_factorial
from clusterloom.operators import blockmodel, graph, kcore, localmove, refine
from clusterloom.operators.components import connected_components
from clusterloom.plans.config import allowed_refinements, parse_algorithm, routes
from clusterloom.sources.edges import profile, read_edges

BRIDGED = [("1", "2"), ("2", "3"), ("1", "3"), ("4", "5"), ("5", "6"), ("4", "6"), ("3", "4")]
TAIL = [("1", "2"), ("2", "3"), ("1", "3"), ("3", "4")]
CLIQUE = [("1", "2"), ("1", "3"), ("1", "4"), ("2", "3"), ("2", "4"), ("3", "4"), ("5", "6"), ("6", "7"), ("5", "7"), ("4", "5")]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster_id"], set()).add(r["node_id"])
    return [out[k] for k in sorted(out)]


def test_cores_and_ikc(spark):
    assert {r["core"] for r in kcore.core_numbers(frame(spark, BRIDGED)).collect()} == {2}
    assert {r["node"]: r["core"] for r in kcore.core_numbers(frame(spark, TAIL)).collect()} == {"1": 2, "2": 2, "3": 2, "4": 1}
    assert clusters(kcore.iterative_k_core(frame(spark, BRIDGED), 2)) == [set("123456")]
    assert clusters(kcore.iterative_k_core(frame(spark, BRIDGED), 3)) == []
    assert clusters(kcore.iterative_k_core(frame(spark, TAIL), 1)) == [set("123")]
    assert clusters(kcore.iterative_k_core(frame(spark, CLIQUE), 2)) == [set("1234"), set("567")]
    assert {r["core"] for r in kcore.core_numbers(frame(spark, [("a", "b"), ("b", "a")])).collect()} == {2}
    assert clusters(kcore.iterative_k_core(frame(spark, [("a", "a")]), 1)) == []


def test_profiles_and_labels(spark):
    e = frame(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c")])
    assert {r["node"]: r["degree"] for r in graph.degrees(profile(e, "loopless_multi")).collect()} == {"a": 2, "b": 3, "c": 1}
    assert profile(e, "simple").count() == 2
    assert graph.nodes(e).count() == 3
    with pytest.raises(ValueError):
        profile(e, "other")
    c = spark.createDataFrame([("p", 9), ("q", 9), ("r", 4), ("s", 4), ("t", 7)], "node_id string, cluster_id long")
    assert clusters(graph.renumbered(graph.without_singletons(c))) == [{"r", "s"}, {"p", "q"}]
    assert graph.without_singletons(spark.createDataFrame([("1", 0), ("2", 1)], "node_id string, cluster_id long")).count() == 0


def test_reads_ids_as_text(spark, tmp_path):
    (tmp_path / "e.csv").write_text("target,source,weight\n2,007,1.5\nx,NA,2\n")
    rows = {(r["src"], r["dst"], r["weight"]) for r in read_edges(spark, str(tmp_path / "e.csv"), weighted=True).collect()}
    assert rows == {("007", "2", 1.5), ("NA", "x", 2.0)}
    (tmp_path / "bad.csv").write_text("source,target\n,4\n")
    with pytest.raises(ValueError):
        read_edges(spark, str(tmp_path / "bad.csv"))


def test_refinements(spark):
    one = lambda names: spark.createDataFrame([(n, 0) for n in names], "node_id string, cluster_id long")
    assert clusters(refine.connected_clusters(frame(spark, BRIDGED[:-1]), one("123456"))) == [set("123"), set("456")]
    path = [(str(i), str(i + 1)) for i in range(1, 10)]
    assert clusters(refine.well_connected_clusters(frame(spark, path[:4]), one([str(i) for i in range(1, 6)]), "1log_10(n)")) == [{"1", "2", "3", "4", "5"}]
    cut = clusters(refine.well_connected_clusters(frame(spark, path), one([str(i) for i in range(1, 11)]), "1log_10(n)"))
    assert all(len(c) < 10 for c in cut)
    assert refine.criterion_text(None) == ("1log_10(n)", "0.2n^0.5") and refine.criterion_text("sqrt") == ("0.2n^0.5",) * 2
    with pytest.raises(ValueError):
        refine.parse_criterion("n of 3")


@pytest.mark.parametrize("model", ["mod", "infomap"])
def test_local_move_finds_planted_groups(spark, model):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(6) for j in range(i)] + [("a0", "b0"), ("b1", "c1")]
    assert sorted(map(sorted, clusters(localmove.local_move(frame(spark, pairs), model)))) == [[f"{g}{i}" for i in range(6)] for g in "abc"]


@pytest.mark.parametrize("model", ["mod", "infomap"])
def test_distributed_moves_find_planted_groups(spark, model, monkeypatch):
    rng = random.Random(3)
    pairs = {(i, j) for i in range(90) for j in range(i) if rng.random() < (0.6 if i // 15 == j // 15 else 0.01)}
    edges = spark.createDataFrame([(f"{a:02d}", f"{b:02d}") for a, b in sorted(pairs)], "src string, dst string")
    groups: dict[str, set] = {}
    ready = localmove.prepared(edges)
    monkeypatch.setattr(localmove, "IN_TASK_EDGES", 60)
    for r in localmove.local_labels(ready, model).collect():
        groups.setdefault(r["piece"], set()).add(r["node_id"])
    assert all(k == min(v) for k, v in groups.items()) and sum(map(len, groups.values())) == 90
    planted = [{f"{i:02d}" for i in range(g, g + 15)} for g in range(0, 90, 15)]
    same = sum(len(a & b) * (len(a & b) - 1) / 2 for a in groups.values() for b in planted)
    assert same >= 0.9 * 6 * 105 and same >= 0.9 * sum(len(a) * (len(a) - 1) / 2 for a in groups.values())


def test_cuts_like_all_subsets():
    rng = random.Random(5)
    for n in range(2, 8):
        for _ in range(20):
            links = [{} for _ in range(n)]
            for i in range(n):
                for j in range(i):
                    if rng.random() < 0.6:
                        links[i][j] = links[j][i] = float(rng.randint(1, 3))
            cost = lambda side: sum(w for u in side for v, w in links[u].items() if v not in side)  # noqa: B023, E731
            least = min(cost({v for v in range(n) if bits >> v & 1}) for bits in range(1, 2**n - 1))
            weight, side = refine.min_cut(links)
            assert weight == least == cost(set(side)) and 0 < len(side) < n


def test_connectivity_modifier(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0")]
    edges = frame(spark, pairs)
    one = graph.nodes(edges).selectExpr("node AS node_id", "0L AS cluster_id")
    for model in ("mod", "cpm"):
        assert clusters(localmove.modified_clusters(edges, one, "1log_10(n)", model, 0.5)) == [{f"{g}{i}" for i in range(6)} for g in "ab"]
    cut = refine.cluster_cuts(edges, one).first()
    assert (cut["n"], cut["min_cut"]) == (12, 1.0)


def test_description_lengths(spark):
    """A triangle in one block, worked by hand, and two planted groups."""
    triangle, one = frame(spark, BRIDGED[:3]), spark.createDataFrame([(v, 0) for v in "123"], "node_id string, cluster_id long")
    # One block: P(b) = 1/3, P(e) = 1 and 6!! = 48; ndc: 48 / 3^6; dc: 48 x 2^3 / 6! / C(8, 6).
    ndc = blockmodel.description_length(triangle, one, "ndc").first()["entropy"]
    dc = blockmodel.description_length(triangle, one, "dc").first()["entropy"]
    assert ndc == pytest.approx(-math.log(48 / 3**6 / 3)) and dc == pytest.approx(-math.log(48 * 8 / 720 / 28 / 3))
    pairs = [(f"{g}{i:02d}", f"{g}{j:02d}") for g in "ab" for i in range(12) for j in range(i)] + [("a00", "b00")]
    winner, blocks, table = blockmodel.best_blocks(frame(spark, pairs))
    assert winner in blockmodel.MODELS and table.count() == 3
    assert sorted(map(sorted, clusters(blocks))) == [[f"{g}{i:02d}" for i in range(12)] for g in "ab"]
    with pytest.raises(ValueError):
        blockmodel.description_length(triangle, one, "other")


def test_nested_block_models(spark):
    """Level 0 covers every node; the length is never above the flat one's by more than the top group's share."""
    rng = random.Random(3)
    pairs = [(f"{a:02}", f"{b:02}") for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.9 if a // 5 == b // 5 else 0.3 if a // 10 == b // 10 else 0.02)]
    edges = frame(spark, pairs)
    tried = blockmodel.candidates(edges)
    levels, length = blockmodel.nested_blocks(edges, "dc", tried=tried)
    blocks, flat = blockmodel.fit_blocks(edges, "dc", tried=tried)
    assert levels[0].select("node_id").distinct().count() == levels[0].count() == graph.nodes(edges).count()
    assert length <= flat + math.log(blocks.select("cluster_id").distinct().count()) + 1e-9
    counts = [x.select("cluster_id").distinct().count() for x in levels]
    assert counts == sorted(counts, reverse=True)
    with pytest.raises(ValueError):
        blockmodel.nested_blocks(edges, "pp")


def test_level_length_counts_multigraphs(spark):
    """Two groups of two blocks with 2 edges inside the first, 1 across: C(4,2) = 6 loops or pairs, 4 places across."""
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "node_id string, cluster_id string")
    above = spark.createDataFrame([("x", "x", 2.0), ("x", "y", 1.0)], "src string, dst string, weight double")
    b, length = blockmodel.level_length(groups, above)
    partition = math.log(math.factorial(4) / (2 * 2)) + math.log(3) + math.log(4)
    assert b == 2 and math.isclose(length, math.log(6) + math.log(4) + partition, rel_tol=1e-9)


def test_accuracy_policies(spark):
    """Truth {1,2,3},{4}; found {1,2}, rest unlabelled: singletons add the pairs that found misses."""
    nodes = spark.createDataFrame([(x,) for x in "1234"], "node string")
    truth = spark.createDataFrame([("1", 0), ("2", 0), ("3", 0), ("4", 1)], "node_id string, cluster_id long")
    found = spark.createDataFrame([("1", 7), ("2", 7)], "node_id string, cluster_id long")
    rows = {r["policy"]: r for r in measures.accuracy(nodes, truth, found).collect()}
    assert (rows["intersection"]["nodes"], rows["intersection"]["recall"], rows["intersection"]["fnr"]) == (2, 1.0, 0.0)
    assert (rows["singletons"]["nodes"], rows["singletons"]["precision"], rows["singletons"]["fpr"]) == (4, 1.0, 0.0)
    assert math.isclose(rows["singletons"]["fnr"], 2 / 3, abs_tol=1e-6)


def test_log_factorials(spark):
    got = spark.range(0, 400).select("id", log_factorial(F.col("id")).alias("x")).collect()
    assert all(r["x"] == pytest.approx(math.lgamma(r["id"] + 1), abs=1e-9) for r in got)


def test_measures(spark):
    models = spark.createDataFrame([(0, "dc", float("nan")), (1, "ndc", 3.0), (2, "pp", 3.0)], "ord int, model string, entropy double")
    assert measures.best_model(models).first()["model"] == "ndc"
    same = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "node_id string, cluster_id long")
    got = measures.agreement(same, same).first()
    assert (got["ari"], got["nmi"], got["f1"]) == (1.0, 1.0, 1.0)
    assert measures.adjusted_information(same, same).first()["ami"] == 1.0
    assert tuple(measures.size_distribution(same).first()) == (2, 2, 2.0, 2.0, 2)


def test_configuration():
    assert parse_algorithm("leiden-cpm-1e-3").resolution == 1e-3 and parse_algorithm("ikc-10").k == 10
    for bad in ("ikc", "leiden", "leiden-cpm", "sbm-nested-pp", "louvain"):
        with pytest.raises(ValueError):
            parse_algorithm(bad)
    every = ("cc", "wcc", "cm")
    assert [allowed_refinements(parse_algorithm(a), every) for a in ("ikc-1", "leiden-mod", "sbm-flat-dc", "infomap")] == [(), ("cm",), ("cc", "wcc"), ("cc",)]
    r = routes(synthetic=True, network="n", generator="g", gt_id="t")
    assert r.edges.endswith("/g/t/n/0/edge.csv") and r.output("clusterings", "sbm-flat-dc", "wcc", "log") == "data/estimated_clusterings/g/t/clusterings/sbm-flat-dc+wcc(log)/n/0"
    with pytest.raises(ValueError):
        routes(real=True, synthetic=True, network="n")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=25))
def test_components_like_plain_search(spark, pairs):
    label = {v: v for p in pairs for v in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == label


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert connected_components(none).count() == 0 and kcore.core_numbers(none).count() == 0
    assert kcore.iterative_k_core(none, 1).select(F.count("*")).first()[0] == 0


def plain_cores(pairs):
    """Core numbers of a multigraph by taking off the node of least degree, again and again."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, []), near.setdefault(b, [])
        if a != b:
            near[a].append(b), near[b].append(a)
    core, k, left = {}, 0, dict(near)
    degree = {v: len(n) for v, n in near.items()}
    while left:
        v = min(left, key=degree.get)
        k = max(k, degree[v])
        core[v] = k
        for u in left.pop(v):
            degree[u] -= u in left
    return core


def test_folding_keeps_core_numbers(spark, monkeypatch):
    """Trees, chains, rings, double edges and denser parts; folding from the first round on."""
    monkeypatch.setattr(kcore, "PATIENCE", 1)
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 201), (200, 201), (300, 300), (400, 401)]
    pairs += [(500 + i, 500 + rng.randrange(max(1, i))) for i in range(1, 40)] + [(5, 300), (20, 500), (30, 31)]
    pairs += [(600 + rng.randrange(25), 600 + rng.randrange(25)) for _ in range(60)]
    got = kcore.core_numbers(spark.createDataFrame(pairs, "src long, dst long"))
    assert {r["node"]: r["core"] for r in got.collect()} == plain_cores(pairs)


def test_cores_of_a_long_path(spark):
    path = spark.range(5000).selectExpr("id AS src", "id + 1 AS dst")
    assert kcore.core_numbers(path).groupBy("core").count().collect() == [(1, 5001)]


def test_clusters_are_numbered_by_first_appearance(spark):
    triangles = [(9, 8), (8, 7), (9, 7), (1, 2), (2, 3), (1, 3)]
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(triangles)], "row int, src long, dst long")
    got = kcore.iterative_k_core(edges, 1, graph.node_index(edges, "row"))
    assert {r["node_id"]: r["cluster_id"] for r in got.collect()} == {9: 0, 8: 0, 7: 0, 1: 1, 2: 1, 3: 1}
