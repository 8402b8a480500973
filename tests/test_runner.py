"""Runs of whole configurations over a small edge list."""

import hashlib
import json

import pytest

from clusterloom.__main__ import main, seconds
from clusterloom.plans import runner
from clusterloom.plans.config import routes
from clusterloom.sources.edges import read_clustering

EDGES = "source,target\n1,2\n2,3\n1,3\n4,5\n5,6\n4,6\n3,4\n"


@pytest.fixture
def edge_file(tmp_path):
    (tmp_path / "e.csv").write_text(EDGES)
    (tmp_path / "truth.csv").write_text("node_id,cluster_id\n1,0\n2,0\n3,0\n4,1\n5,1\n6,1\n")
    return tmp_path


def test_steps_run_once_and_again_after_a_change(spark, edge_file):
    args = ["--algo", "ikc-2", "--input-edgelist", str(edge_file / "e.csv"), "--output-dir", str(edge_file / "out"), "--input-gt-clustering", str(edge_file / "truth.csv"), "--run-stats", "--run-acc", "--run-cm"]
    assert main(args, spark) == 0
    out = edge_file / "out/clusterings/ikc-2"
    assert {r["node_id"] for r in read_clustering(spark, str(out / "com.csv")).collect()} == set("123456")
    com = (out / "com.csv").read_text()
    assert com.splitlines()[0] == "node_id,cluster_id" and com.splitlines()[1:] == sorted(com.splitlines()[1:], key=lambda x: (x.split(",")[1], x))
    assert (out / "done").read_text() == f"{hashlib.sha256(com.encode()).hexdigest()}  {out}/com.csv\n"
    assert set(json.loads((out / "done.json").read_text())["seconds"]) == {"load", "run", "save"} and "saved in" in (out / "run.log").read_text()
    assert f"ikc-2 ran {out}" in (edge_file / "out/complete.log").read_text()
    acc = spark.read.csv(str(edge_file / "out/acc/ikc-2/result"), header=True).collect()
    assert {r["policy"] for r in acc} == {"intersection", "singletons"}
    assert not (edge_file / "out/clusterings/ikc-2+cm").exists()  # the family takes no refinement
    run = lambda: runner.Runner(spark, routes(edges=str(edge_file / "e.csv"), out_dir=str(edge_file / "out")), runner.Settings()).run("ikc-2").steps[str(out)]
    assert run() == "kept"
    (edge_file / "e.csv").write_text(EDGES + "7,8\n7,9\n8,9\n")
    assert run() == "ran"
    assert {r["node_id"] for r in read_clustering(spark, str(out / "com.csv")).collect()} == set("123456789")


def test_a_failed_step_leaves_no_manifest(spark, edge_file):
    found = routes(edges=str(edge_file / "e.csv"), out_dir=str(edge_file / "out"))
    r = runner.Runner(spark, found, runner.Settings())
    folder = str(edge_file / "out/x")
    one = lambda: {"t": spark.createDataFrame([(1,)], "a int")}
    assert r.step(folder, {"p": 1}, [found.edges], one) == folder
    with pytest.raises(ZeroDivisionError):
        r.step(folder, {"p": 2}, [found.edges], lambda: 1 / 0)
    assert not (edge_file / "out/x/done.json").exists()
    r.step(folder, {"p": 1}, [found.edges], one)
    assert r.report.steps[folder] == "ran"


def test_a_step_ends_at_its_time_limit(spark, edge_file):
    found = routes(edges=str(edge_file / "e.csv"), out_dir=str(edge_file / "out"))
    r = runner.Runner(spark, found, runner.Settings())
    slow = lambda: {"t": spark.range(0, 1 << 42, 1, 2).selectExpr("sum(hash(id)) AS a")}
    with pytest.raises(Exception):  # noqa: B017
        r.step(str(edge_file / "out/slow"), {}, [found.edges], slow, timeout=2.0)
    assert spark.range(3).count() == 3


def test_best_model_aliases_the_winner(spark, edge_file, monkeypatch):
    com = spark.createDataFrame([("1", 0), ("2", 0)], "node_id string, cluster_id long")
    length = {"sbm-flat-dc": 3.0, "sbm-flat-ndc": 1.0, "sbm-flat-pp": 1.0}
    monkeypatch.setattr(runner, "cluster", lambda e, a, *more: {"com.csv": com, "entropy.txt": f"{length[a.name]}\n"})
    found = routes(edges=str(edge_file / "e.csv"), out_dir=str(edge_file / "out"))
    steps = runner.Runner(spark, found, runner.Settings(refinements=("cc",))).run("sbm-flat-best").steps
    own = str(edge_file / "out/clusterings/sbm-flat-best")
    assert steps[own] == "alias" and steps[own + "+cc"] == "alias"
    assert runner.resolve(spark, own) == str(edge_file / "out/clusterings/sbm-flat-ndc")
    assert (edge_file / "out/clusterings/sbm-flat-best/best_model.txt").read_text() == "sbm-flat-ndc\n"
    assert (edge_file / "out/clusterings/sbm-flat-best/models.txt").read_text() == "model,entropy\nsbm-flat-dc,3.0\nsbm-flat-ndc,1.0\nsbm-flat-pp,1.0\n"
    assert runner.best_of(spark, own) == "sbm-flat-ndc"
    with pytest.raises(ValueError, match="2 models"):
        runner.choose_best(spark, ["a", "b"], ["x"], own)
    assert json.loads((edge_file / "out/clusterings/sbm-flat-ndc/done.json").read_text())["key"]["params"]["algorithm"] == "sbm-flat-ndc"


def test_durations():
    assert (seconds("90"), seconds("5m"), seconds("7d")) == (90, 300, 604800)


def test_weights_and_history_of_the_modifier(spark, edge_file):
    (edge_file / "w.csv").write_text("source,target,weight\n" + "".join(f"{a},{b},{5 if (a, b) != (3, 4) else 0.1}\n" for a, b in [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]))
    args = ["--algo", "leiden-mod", "--weighted", "--n-iterations", "-1", "--input-edgelist", str(edge_file / "w.csv"), "--output-dir", str(edge_file / "out"), "--run-cm", "--criterion", "0.5"]
    assert main(args, spark) == 0
    base = edge_file / "out/clusterings/leiden-mod"
    assert {r["node_id"]: r["cluster_id"] for r in read_clustering(spark, str(base / "com.csv")).collect()} == {"1": 0, "2": 0, "3": 0, "4": 1, "5": 1, "6": 1}
    cm = edge_file / "out/clusterings/leiden-mod+cm(0.5)"
    assert (cm / "history.log").read_text() == "before,after,nodes\n0,0,3\n1,1,3\n" and "ran in" in (cm / "cm.log").read_text()


def test_ikc_clusters_are_numbered_by_the_edge_list(spark, edge_file):
    """Equal cores: the cluster of the first row comes first, whatever the ids."""
    (edge_file / "e.csv").write_text("source,target\nz,y\ny,x\nz,x\n1,2\n2,3\n1,3\n10,11\n11,12\n10,12\n")
    r = runner.Runner(spark, routes(edges=str(edge_file / "e.csv"), out_dir=str(edge_file / "out")), runner.Settings())
    r.run("ikc-2")
    own = edge_file / "out/clusterings/ikc-2"
    assert (own / "output.log").read_text() == (own / "run.log").read_text() and "elapsed seconds" in (own / "error.log").read_text()
    with pytest.raises(ZeroDivisionError):
        r.step(str(edge_file / "out/x"), {}, [], lambda: 1 / 0)
    assert "ZeroDivisionError" in (edge_file / "out/x/error.log").read_text()
    got = {x["node_id"]: x["cluster_id"] for x in read_clustering(spark, str(edge_file / "out/clusterings/ikc-2/com.csv")).collect()}
    assert [got[v] for v in ("z", "y", "x", "1", "2", "3", "10", "11", "12")] == [0, 0, 0, 1, 1, 1, 2, 2, 2]
