"""Minimum cuts of many small clusters share a few Python groups."""

from clusterloom.operators import refine


def test_small_clusters_share_bins(spark, monkeypatch):
    pairs, label, want = [], [], {}
    for c in range(60):
        n = 2 + c % 5
        nodes = [100 * c + i for i in range(n)]
        ring = c % 2 and n > 2
        pairs += [(nodes[i], nodes[i + 1]) for i in range(n - 1)] + ([(nodes[-1], nodes[0])] if ring else [])
        label += [(v, c) for v in nodes]
        want[c] = (n, 2.0 if ring else 1.0)
    label.append((9999, 60))
    asked = []
    binned = refine._binned
    monkeypatch.setattr(refine, "_binned", lambda *x: asked.append(out := binned(*x)) or out)  # there was a group for each cluster
    monkeypatch.setattr(refine, "CUT_BIN_EDGES", 40)
    found = refine.cluster_cuts(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(label, "node_id long, cluster_id long"))
    assert {r["cluster_id"]: (r["n"], r["min_cut"]) for r in found.collect() if r["n"] > 1} == want
    assert 1 < asked[0].select("bin").distinct().count() <= len(pairs) // 40 + 1
