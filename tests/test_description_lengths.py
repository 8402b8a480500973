"""Description lengths of all models come from one count of the graph."""

from clusterloom.operators import blockmodel
from clusterloom.plans import queries


def test_all_models_share_one_count(spark, monkeypatch):
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 30) for i in range(60)], "src long, dst long")
    blocks = spark.createDataFrame([(i, i % 4) for i in range(25)], "node_id long, cluster_id long")
    each = [blockmodel.description_length(edges, blocks, model).first() for model in blockmodel.MODELS]
    written = []
    stored = blockmodel.stored
    monkeypatch.setattr(blockmodel, "stored", lambda df: written.append(df.columns) or stored(df))
    best = queries._best_model(edges, blocks).first()
    assert written.count(["r", "s", "m"]) == 1  # was once for each model
    lengths = blockmodel.description_lengths(edges, blocks).orderBy("ord").collect()
    assert [r["model"] for r in lengths] == list(blockmodel.MODELS)
    assert [tuple(r)[2:] for r in lengths] == [tuple(r) for r in each]
    assert best["entropy"] == min(round(r["entropy"], 4) for r in each)
