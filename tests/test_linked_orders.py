"""Links of each part of an order with its least one connect what all pairs connect."""

import random

import pytest

from clusterloom.operators.components import connected_components
from clusterloom.plans import queries


@pytest.mark.parametrize("kind", ["", "_whole"])
def test_links_keep_components_and_are_no_more_than_rows(spark, kind, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(60) or None, rng.randrange(150) or None, 45, "R") for _ in range(160)]
    rows += [(900, 7, 45, "R"), (900, 7, 45, "R"), (901, 500, 45, "R")]  # a part alone in its order is no node
    rows += [(902, 600 + i, 45, "R") for i in range(80)]  # 3,160 pairs of one order
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs, links = (getattr(queries, name + kind)(spark, str(tmp_path)) for name in ("copart", "linked"))
    assert links.count() <= len(rows) < pairs.count()
    assert sorted(map(tuple, connected_components(links).collect())) == sorted(map(tuple, connected_components(pairs).collect()))
