"""The graph queries over all rows of the tables, on the smallest one."""

import duckdb
import pytest

from clusterloom.plans import queries

D = "/root/testdata/sf0.001"


def _rows(rows):
    return sorted(tuple(x if isinstance(x, str) else round(float(x), 4) for x in r) for r in rows)


def test_every_filtered_graph_query_has_a_whole_twin(spark):
    found = queries.queries()
    assert {f"{n}_whole" for n in found if n not in (*queries.NO_EDGES, *queries.NO_TWIN) and not n.endswith("_whole")} <= set(found)
    assert queries.copart_whole(spark, D).count() == 8899  # FIXTURES.md


@pytest.mark.parametrize("name", ["edge_multigraph", "node_index", "degree_in_out", "connected_components", "core_numbers", "cluster_stats", "accuracy"])
def test_whole_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{D}/{table}.parquet'")
    got = queries.queries()[f"{name}_whole"](spark, D)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[f'{name}_whole']})").fetchall()
    assert _rows(got.collect()) == _rows(want)
