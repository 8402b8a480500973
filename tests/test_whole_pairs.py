"""The whole co-purchase graph: parted by the size of its table."""

from clusterloom.plans import queries


def test_pairs_are_dealt_by_the_tables_size(spark, tmp_path, monkeypatch):
    rows = [(o, p % 90) for o in range(300) for p in (o, o * 7 + 1, o * 13 + 5)] + [(None, 5), (7, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    asked = []
    repartition = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *by: asked.append(n) or repartition(self, n, *by))
    monkeypatch.setattr(queries, "ROWS_IN_PART", 100)
    found = {tuple(r) for r in queries.copart_whole(spark, str(tmp_path)).collect()}
    by_order: dict = {}
    for o, p in rows:
        if o is not None and p is not None:
            by_order.setdefault(o, set()).add(p)
    assert found == {(a, b) for x in by_order.values() for a in x for b in x if a < b}
    assert asked and set(asked) == {10}  # 902 rows; was whatever adaptive execution made of their bytes
