"""Queries over the test tables and the SQL that states their results."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.functions import measures
from clusterloom.operators import blockmodel, graph, kcore, localmove, refine
from clusterloom.operators.components import connected_components
from clusterloom.sources.edges import profile
from clusterloom.sources.storage import stored

COPART = """SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
WHERE a.l_quantity >= 40 AND b.l_quantity >= 40 AND a.l_returnflag = 'R' AND b.l_returnflag = 'R'"""
ORDERS_PARTS = "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_quantity >= 48 AND l_returnflag = 'R'"
LOOPED = "SELECT l_suppkey AS src, (l_partkey % 20) + 1 AS dst FROM lineitem WHERE l_quantity >= 48"


#: The same graphs over all rows of the tables, for the queries named ``*_whole``.
COPART_WHOLE = """SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey"""
ORDERS_PARTS_WHOLE = "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem"
#: Rows of ``lineitem`` for each partition of the whole graph.
ROWS_IN_PART = 250_000
#: Queries that read no edges of ``lineitem``; they have no cut and no ``*_whole`` twin.
NO_EDGES = ("singleton_filter", "dense_renumber", "removed_counts", "criterion_eval", "agreement", "ami")
#: Queries that were not shown to finish over all rows of sf0.01 in minutes, so they have no twin.
NO_TWIN = ("cm_after_cpm", "sbm_flat_best", "sbm_nested_dc")
#: Queries whose SQL is unrolled or lists subsets, so that it states the filtered graphs only.
SMALL_SQL = ("k_valid", "ikc_k1", "ikc_k2", "cluster_cuts")


def _items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(*columns)


def copart(spark: SparkSession, d: str) -> DataFrame:
    """Parts bought together in large returned quantities."""
    x = _items(spark, d, "l_orderkey", "l_partkey", "l_quantity", "l_returnflag").where("l_quantity >= 40 AND l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    pairs = x.withColumnRenamed("l_partkey", "src").join(x.withColumnRenamed("l_partkey", "dst"), "l_orderkey")
    return pairs.where("src < dst").select("src", "dst").distinct()


def supplied(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "l_suppkey", "l_partkey", "l_quantity", "l_returnflag").where("l_quantity >= 48 AND l_returnflag = 'R'").selectExpr("l_suppkey AS src", "l_partkey AS dst")


def looped(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "l_suppkey", "l_partkey", "l_quantity").where("l_quantity >= 48").selectExpr("l_suppkey AS src", "l_partkey % 20 + 1 AS dst")


def copart_whole(spark: SparkSession, d: str) -> DataFrame:
    """Parts bought together, over all rows.

    Orders and then pairs are dealt to as many partitions as the table's size asks for, so that a task's rows do not grow with it."""
    x = _items(spark, d, "l_orderkey", "l_partkey").where("l_orderkey IS NOT NULL")
    parts = math.ceil(x.count() / ROWS_IN_PART) or 1
    x = x.repartition(parts, "l_orderkey").distinct()
    pairs = x.withColumnRenamed("l_partkey", "src").join(x.withColumnRenamed("l_partkey", "dst"), "l_orderkey")
    return stored(pairs.where("src < dst").select("src", "dst").repartition(parts, "src", "dst").distinct())


def _with_least(items: DataFrame) -> DataFrame:
    """Each other part of an order with its least one: not all pairs bought together, but the same nodes and connected components."""
    least = items.groupBy("l_orderkey").agg(F.min("l_partkey").alias("src"))
    return items.join(least, "l_orderkey").where("src < l_partkey").select("src", F.col("l_partkey").alias("dst"))


def linked(spark: SparkSession, d: str) -> DataFrame:
    """Links with the connected components of ``copart``."""
    return _with_least(_items(spark, d, "l_orderkey", "l_partkey", "l_quantity", "l_returnflag").where("l_quantity >= 40 AND l_returnflag = 'R'").select("l_orderkey", "l_partkey"))


def linked_whole(spark: SparkSession, d: str) -> DataFrame:
    """Links with the connected components of ``copart_whole``: no more than rows, so that no pairs are made, told apart or written."""
    x = _items(spark, d, "l_orderkey", "l_partkey").where("l_orderkey IS NOT NULL")
    return _with_least(x.repartition(math.ceil(x.count() / ROWS_IN_PART) or 1, "l_orderkey"))


def supplied_whole(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "l_suppkey", "l_partkey").selectExpr("l_suppkey AS src", "l_partkey AS dst")


def looped_whole(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "l_suppkey", "l_partkey").selectExpr("l_suppkey AS src", "l_partkey % 20 + 1 AS dst")


def by_brand(spark: SparkSession, d: str) -> DataFrame:
    """A clustering of parts: the number in the brand."""
    return spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS node_id", "CAST(p_size AS BIGINT) AS cluster_id")


BY_BRAND = "SELECT p_partkey AS node_id, p_size::BIGINT AS cluster_id FROM part"
#: A clustering that leaves parts of a third of the sizes out.
SOME = f"SELECT * FROM ({BY_BRAND}) WHERE cluster_id % 3 <> 0"


def components_sql(edges: str) -> str:
    return f"""WITH RECURSIVE e AS ({edges}), b AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e),
c(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM b
  UNION SELECT x.node, x.component FROM (SELECT b.u AS node, min(c.component) AS component FROM c JOIN b ON b.v = c.node GROUP BY b.u) x
  JOIN recurring.c o ON o.node = x.node WHERE x.component < o.component)"""


def _component_clustering(edges: DataFrame) -> DataFrame:
    return connected_components(edges).select(F.col("node").alias("node_id"), F.col("component").alias("cluster_id"))


def _k_valid(e: DataFrame) -> DataFrame:
    """Components of the innermost core, and whether every member has in+out degree of at least 2."""
    cores = kcore.core_numbers(e)
    top = cores.agg(F.max("core")).first()[0]
    inner = graph.induced(e, cores.where(F.col("core") == top).select("node"))
    both = graph.adjacency(inner).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return connected_components(inner).join(both, "node").groupBy("component").agg(F.expr("bool_and(degree >= 2)").alias("valid"), F.count(F.lit(1)).alias("n"))


def _coverage(e: DataFrame) -> DataFrame:
    return measures.coverage(e, _component_clustering(e), simple=True)


def _coverage_some(e: DataFrame, clustering: DataFrame) -> DataFrame:
    """Coverage by clusters of the graph's nodes that leave a third of the sizes out."""
    some = clustering.where("cluster_id % 3 <> 0").join(graph.nodes(e), F.col("node_id") == F.col("node"), "left_semi")
    return measures.coverage(e, some, simple=True)


def _valid_parts(e: DataFrame) -> DataFrame:
    """Components of the whole graph, and whether every member has in+out degree of at least 2: many have not."""
    both = graph.adjacency(e).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return connected_components(e).join(both, "node").groupBy("component").agg(F.expr("bool_and(degree >= 2)").alias("valid"), F.count(F.lit(1)).alias("n"))


def _best_model(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """The model that describes the parts' sizes as blocks most shortly, of those of one block for each size."""
    return measures.best_model(blockmodel.description_lengths(edges, blocks, known_simple=True).select("ord", "model", F.round("entropy", 4).alias("entropy")))


def _accuracy(s: SparkSession, d: str, nodes: DataFrame) -> DataFrame:
    """Parts by size against a regrouping of the graph's nodes that leaves a third of its clusters out."""
    found = by_brand(s, d).join(nodes, F.col("node_id") == F.col("node"), "left_semi").withColumn("cluster_id", F.expr("(cluster_id + node_id % 2) % 20"))
    return measures.accuracy(nodes, by_brand(s, d), found.where("cluster_id % 3 <> 0"))


def _entropy(edges: DataFrame, blocks: DataFrame, model: str) -> DataFrame:
    found = blockmodel.description_length(edges, blocks, model, known_simple=True)
    return found.withColumn("entropy", F.round("entropy", 4))


def _entropy_sql(model: str) -> str:
    lf = lambda x: f"lgamma(({x})::DOUBLE + 1)"
    choose = lambda n, k: f"CASE WHEN {k} <= 0 OR {k} >= {n} THEN 0 ELSE {lf(n)} - {lf(k)} - {lf(f'{n} - {k}')} END"
    fit = {
        "dc": f"e0 + lfk - lfe - ({choose('b * (b + 1) // 2 + e - 1', 'e')}) - degs",
        "ndc": f"e0 - spread - ({choose('b * (b + 1) // 2 + e - 1', 'e')})",
        "pp": f"{lf('e_in')} + {lf('e - e_in')} - e_in * ln(b / 2) - CASE WHEN b > 1 THEN (e - e_in) * ln(b * (b - 1) / 2) + ln(e + 1) ELSE 0 END + pp + lfk",
    }[model]
    return f"""WITH e AS ({COPART}), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), k AS ({BY_BRAND}),
l AS (SELECT node, cluster_id AS r FROM v JOIN k ON node = node_id),
x AS (SELECT least(a.r, b.r) AS r, greatest(a.r, b.r) AS s, count(*) AS m FROM e JOIN l a ON src = a.node JOIN l b ON dst = b.node GROUP BY 1, 2),
c AS (SELECT sum(m)::BIGINT AS e, sum(m) FILTER (r = s)::BIGINT AS e_in, sum({lf('m')} + CASE WHEN r = s THEN m * ln(2) ELSE 0 END) AS e0 FROM x),
g AS (SELECT r, sum(m)::BIGINT AS er FROM (SELECT r, m FROM x UNION ALL SELECT s, m FROM x) GROUP BY r),
n AS (SELECT r, count(*) AS nr FROM l GROUP BY r), q AS (SELECT nr, coalesce(er, 0) AS er FROM n LEFT JOIN g USING (r)),
p AS (SELECT count(*) AS b, sum(nr)::BIGINT AS n, sum({lf('nr')}) AS lfn, sum({lf('er')}) AS lfe, sum({choose('(nr + er - 1)', 'er')}) AS degs,
sum(er * ln(nr)) AS spread, sum({lf('nr - 1')} - {lf('er + nr - 1')}) AS pp FROM q),
d AS (SELECT sum({lf('k')}) AS lfk FROM (SELECT count(*) AS k FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) GROUP BY v))
SELECT n, e, b, round(-({fit}) - (lfn - {lf('n')} - ({choose('(n - 1)', '(b - 1)')}) - ln(n)), 4) AS entropy FROM c, p, d"""


def cores_sql(edges: str, name: str) -> str:
    """Two CTEs: both directions of ``edges`` and the core numbers ``name`` (node, core), by h-index rounds."""
    return f"""{name}_b AS (SELECT src AS u, dst AS v FROM {edges} UNION ALL SELECT dst, src FROM {edges}),
{name}(node, core) USING KEY (node) AS (SELECT u, count(*) FROM {name}_b GROUP BY u
  UNION SELECT o.node, h.core FROM (SELECT u, max(least(core, place)) AS core FROM
    (SELECT b.u, r.core, row_number() OVER (PARTITION BY b.u ORDER BY r.core DESC) AS place FROM {name}_b b JOIN recurring.{name} r ON r.node = b.v) GROUP BY u) h
  JOIN recurring.{name} o ON o.node = h.u, (SELECT count(*) AS changed FROM {name}) WHERE h.core < o.core AND changed > 0)"""


def ikc_sql(k: int, levels: int = 6) -> str:
    """Iterative k-core with ``levels`` unrolled levels, more than the filtered graph has."""
    parts = [f"e0 AS ({COPART})"]
    for i in range(1, levels + 1):
        parts.append(cores_sql(f"e{i - 1}", f"c{i}"))
        parts.append(f"""t{i} AS (SELECT node FROM c{i} WHERE core = (SELECT max(core) FROM c{i}) AND core >= {max(k, 1)}),
i{i} AS (SELECT src AS u, dst AS v FROM e{i - 1} WHERE src IN (FROM t{i}) AND dst IN (FROM t{i})), d{i} AS (SELECT u, v FROM i{i} UNION SELECT v, u FROM i{i}),
p{i}(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM d{i}
  UNION SELECT x.node, x.component FROM (SELECT d.u AS node, min(p.component) AS component FROM p{i} p JOIN d{i} d ON d.v = p.node GROUP BY d.u) x
  JOIN recurring.p{i} o ON o.node = x.node WHERE x.component < o.component),
e{i} AS (SELECT * FROM e{i - 1} WHERE EXISTS (FROM t{i}) AND src NOT IN (FROM t{i}) AND dst NOT IN (FROM t{i}))""")
    every = " UNION ALL ".join(f"SELECT node, component, (SELECT max(core) FROM c{i})::INTEGER AS k FROM p{i}" for i in range(1, levels + 1))
    return "WITH RECURSIVE " + ",\n".join(parts) + f""" SELECT node AS node_id, dense_rank() OVER (ORDER BY -k, component) - 1 AS cluster_id, k FROM ({every})"""


def k_valid_sql() -> str:
    """Components of the innermost core, with the least degree in it compared to 2."""
    one = ikc_sql(1, 1).rpartition(" SELECT node AS node_id")[0]
    return f"""{one}, g AS (SELECT u, count(*) AS degree FROM (SELECT u FROM i1 UNION ALL SELECT v FROM i1) GROUP BY u)
SELECT component, min(degree) >= 2 AS valid, count(*) AS n FROM p1 JOIN g ON u = node GROUP BY component"""


def cluster_cuts_sql() -> str:
    """The least cut of each component over all subsets of its nodes; for components of a few nodes only."""
    return f"""{components_sql(COPART)},
b0 AS (SELECT node, component, row_number() OVER (PARTITION BY component ORDER BY node) - 1 AS bit FROM c),
s AS (SELECT component, count(*) AS n FROM c GROUP BY component),
m AS (SELECT component, unnest(range(1, 1::BIGINT << (n - 1)::BIGINT)) AS mask FROM s),
x AS (SELECT a.component, a.bit AS ba, z.bit AS bz FROM e JOIN b0 a ON a.node = src JOIN b0 z ON z.node = dst),
k AS (SELECT m.component, m.mask, count(*) FILTER ((mask >> ba) & 1 <> (mask >> bz) & 1) AS cut FROM m JOIN x USING (component) GROUP BY ALL),
r AS (SELECT component, min(cut)::DOUBLE AS min_cut FROM k GROUP BY component)
SELECT component AS cluster_id, n, min_cut, round(min_cut / log10(n), 6) AS cut_log, round(min_cut / sqrt(n), 6) AS cut_sqrt FROM s JOIN r USING (component)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each operator over the small filtered graphs, and as ``*_whole`` over all rows."""
    whole = _queries(copart_whole, supplied_whole, looped_whole, "true", linked_whole)
    return _queries(copart, supplied, looped, "l_quantity >= 48", linked) | {f"{name}_whole": query for name, query in whole.items() if name not in (*NO_EDGES, *NO_TWIN)}


def _queries(copart: Callable, supplied: Callable, looped: Callable, indexed: str, linked: Callable = linked) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "edge_multigraph": lambda s, d: profile(looped(s, d), "multigraph").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")),
        "edge_loopless": lambda s, d: profile(looped(s, d), "loopless_multi").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")),
        "edge_simple": lambda s, d: profile(looped(s, d), "simple").select("src", "dst"),
        "edge_accumulated": lambda s, d: profile(looped(s, d), "accumulated"),
        "node_set": lambda s, d: graph.nodes(supplied(s, d)),
        "node_index": lambda s, d: graph.node_index(s.read.parquet(f"{d}/lineitem.parquet").where(indexed).selectExpr("l_suppkey AS src", "l_partkey AS dst", "l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber"),
        "degree_in_out": lambda s, d: graph.degrees(supplied(s, d)),
        "induced_subgraph": lambda s, d: graph.induced(copart(s, d), graph.nodes(copart(s, d)).where("node % 2 = 0")),
        "remove_nodes": lambda s, d: graph.removed(copart(s, d), graph.nodes(copart(s, d)).where("node % 3 = 0")),
        "singleton_filter": lambda s, d: graph.without_singletons(by_brand(s, d).withColumn("cluster_id", F.expr("node_id % 700"))),
        "dense_renumber": lambda s, d: graph.renumbered(by_brand(s, d).withColumn("cluster_id", F.expr("cluster_id * 7 + 3"))),
        "removed_counts": lambda s, d: graph.removed_counts(by_brand(s, d).withColumn("cluster_id", F.expr("node_id % 1500"))),
        "connected_components": lambda s, d: connected_components(copart(s, d)),
        "component_sizes": lambda s, d: connected_components(copart(s, d)).groupBy("component").agg(F.count(F.lit(1)).alias("n")),
        "core_numbers": lambda s, d: kcore.core_numbers(copart(s, d)),
        "k_valid": lambda s, d: _k_valid(copart(s, d)),
        "ikc_k1": lambda s, d: kcore.iterative_k_core(copart(s, d), 1),
        "ikc_k2": lambda s, d: kcore.iterative_k_core(copart(s, d), 2),
        "best_model": lambda s, d: _best_model(copart(s, d), by_brand(s, d)),
        "criterion_eval": lambda s, d: by_brand(s, d).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).select("cluster_id", "n", F.round(refine.criterion_column("1log_10(n)", F.col("n")), 6).alias("log"), F.round(refine.criterion_column("0.2n^0.5", F.col("n")), 6).alias("sqrt")),
        "cc_refine": lambda s, d: refine.connected_clusters(copart(s, d), by_brand(s, d)),
        "cluster_stats": lambda s, d: measures.cluster_stats(copart(s, d), by_brand(s, d), simple=True),
        "coverage": lambda s, d: _coverage(copart(s, d)),
        "coverage_some": lambda s, d: _coverage_some(copart(s, d), by_brand(s, d)),
        "cluster_components": lambda s, d: measures.cluster_components(copart(s, d), by_brand(s, d), simple=True),
        "k_valid_parts": lambda s, d: _valid_parts(copart(s, d)),
        "contingency": lambda s, d: measures.contingency(by_brand(s, d), _component_clustering(linked(s, d))),
        "agreement": lambda s, d: measures.agreement(by_brand(s, d), by_brand(s, d).withColumn("cluster_id", F.expr("(cluster_id + node_id % 2) % 20"))),
        "wcc_refine": lambda s, d: (lambda e: refine.well_connected_clusters(e, _component_clustering(e), "1log_10(n)"))(copart(s, d)),
        "leiden_mod": lambda s, d: localmove.local_move(copart(s, d), "mod"),
        "leiden_cpm": lambda s, d: localmove.local_move(copart(s, d), "cpm", 0.1),
        "cm_refine": lambda s, d: (lambda e: localmove.modified_clusters(e, _component_clustering(e), "0.2n^0.5"))(copart(s, d)),
        "cm_after_cpm": lambda s, d: localmove.modified_clusters(copart(s, d), localmove.local_move(copart(s, d), "cpm", 0.1), "0.2n^0.5", "cpm", 0.1),
        "cluster_cuts": lambda s, d: (lambda e: refine.cluster_cuts(e, _component_clustering(e)))(copart(s, d)),
        "ami": lambda s, d: measures.adjusted_information(by_brand(s, d), by_brand(s, d).withColumn("cluster_id", F.expr("(cluster_id + node_id % 2) % 20"))),
        "size_distribution": lambda s, d: measures.size_distribution(_component_clustering(copart(s, d))),
        "cpm_score": lambda s, d: measures.cpm_score(copart(s, d), by_brand(s, d), 0.1, simple=True),
        "large_components": lambda s, d: connected_components(copart(s, d)).groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 10"),
        "sbm_entropy_dc": lambda s, d: _entropy(copart(s, d), by_brand(s, d), "dc"),
        "sbm_entropy_ndc": lambda s, d: _entropy(copart(s, d), by_brand(s, d), "ndc"),
        "sbm_entropy_pp": lambda s, d: _entropy(copart(s, d), by_brand(s, d), "pp"),
        "sbm_flat_best": lambda s, d: blockmodel.best_blocks(copart(s, d))[1],
        "sbm_nested_dc": lambda s, d: blockmodel.nested_blocks(copart(s, d), "dc")[0][0],
        "accuracy": lambda s, d: _accuracy(s, d, stored(graph.nodes(copart(s, d)))),
        "infomap": lambda s, d: localmove.local_move(copart(s, d), "infomap"),
    }


_SIMPLE = "(SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ({}) WHERE src <> dst)"


def _whole_sql(sql: str) -> str:
    """A query's SQL over all rows."""
    return sql.replace(COPART, COPART_WHOLE).replace(ORDERS_PARTS, ORDERS_PARTS_WHOLE).replace(" WHERE l_quantity >= 48", "")


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    return found | {f"{name}_whole": _whole_sql(sql) for name, sql in found.items() if name not in (*NO_EDGES, *NO_TWIN, *SMALL_SQL)}


def _oracle_sql() -> dict[str, str]:
    comp = components_sql(COPART)
    nodes = "(SELECT src AS node FROM e UNION SELECT dst FROM e)"
    regroup = "(SELECT node_id, (cluster_id + node_id % 2) % 20 AS b FROM ({}))".format(BY_BRAND)
    return {
        "edge_multigraph": f"SELECT src, dst, count(*) AS n FROM ({LOOPED}) GROUP BY ALL",
        "edge_loopless": f"SELECT src, dst, count(*) AS n FROM ({LOOPED}) WHERE src <> dst GROUP BY ALL",
        "edge_simple": f"SELECT * FROM {_SIMPLE.format(LOOPED)}",
        "edge_accumulated": f"SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*)::DOUBLE AS weight FROM ({LOOPED}) GROUP BY 1, 2",
        "node_set": f"WITH e AS ({ORDERS_PARTS}) SELECT node FROM {nodes}",
        "node_index": """WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, l_orderkey AS o, l_linenumber AS l FROM lineitem WHERE l_quantity >= 48),
f AS (SELECT node, min((side, o, l)) AS first FROM (SELECT src AS node, 0 AS side, o, l FROM e UNION ALL SELECT dst, 1, o, l FROM e) GROUP BY node)
SELECT node, row_number() OVER (ORDER BY first, node) - 1 AS idx FROM f""",
        "degree_in_out": f"""WITH e AS ({ORDERS_PARTS}) SELECT node, count(*) FILTER (s = 1) AS d_in, count(*) FILTER (s = 0) AS d_out, count(*) AS degree
FROM (SELECT src AS node, 0 AS s FROM e UNION ALL SELECT dst, 1 FROM e) GROUP BY node""",
        "induced_subgraph": f"SELECT * FROM ({COPART}) WHERE src % 2 = 0 AND dst % 2 = 0",
        "remove_nodes": f"SELECT * FROM ({COPART}) WHERE src % 3 <> 0 AND dst % 3 <> 0",
        "singleton_filter": "SELECT node_id, cluster_id FROM (SELECT p_partkey AS node_id, p_partkey % 700 AS cluster_id, count(*) OVER (PARTITION BY p_partkey % 700) AS n FROM part) WHERE n > 1",
        "dense_renumber": "SELECT p_partkey AS node_id, dense_rank() OVER (ORDER BY p_size * 7 + 3) - 1 AS cluster_id FROM part",
        "removed_counts": """SELECT count(*) FILTER (n = 1) AS removed_nodes, count(*) FILTER (n = 1) AS removed_clusters, count(*) FILTER (n > 1) AS kept_clusters,
coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS kept_nodes FROM (SELECT count(*) AS n FROM part GROUP BY p_partkey % 1500)""",
        "connected_components": f"{comp} SELECT node, component FROM c",
        "component_sizes": f"{comp} SELECT component, count(*) AS n FROM c GROUP BY component",
        "best_model": "SELECT model, entropy FROM (" + " UNION ALL ".join(f"SELECT {i} AS ord, '{m}' AS model, entropy FROM ({_entropy_sql(m)})" for i, m in enumerate(blockmodel.MODELS)) + ") ORDER BY entropy, ord LIMIT 1",
        "criterion_eval": f"SELECT cluster_id, count(*) AS n, round(log10(count(*)), 6) AS log, round(0.2 * sqrt(count(*)), 6) AS sqrt FROM ({BY_BRAND}) GROUP BY cluster_id",
        "coverage_some": f"""WITH e AS ({COPART}), k AS (SELECT * FROM ({SOME}) WHERE node_id IN {nodes}),
x AS (SELECT count(*) AS m, count(*) FILTER (a.cluster_id = b.cluster_id) AS m_in FROM e LEFT JOIN k a ON src = a.node_id LEFT JOIN k b ON dst = b.node_id),
y AS (SELECT count(*) AS nodes FROM {nodes}), z AS (SELECT count(*) AS clustered FROM k)
SELECT nodes, clustered, m, m_in, round(clustered / nodes, 6) AS node_coverage, round(m_in / m, 6) AS edge_coverage FROM x, y, z""",
        "cluster_components": f"""{components_sql(f"SELECT src, dst FROM ({COPART}) JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_size = b.p_size")}
SELECT cluster_id, count(*) AS n, count(DISTINCT component) + count(*) FILTER (component IS NULL) AS components FROM ({BY_BRAND}) LEFT JOIN c ON node = node_id GROUP BY cluster_id""",
        "k_valid_parts": f"{comp}, g AS (SELECT u, count(*) AS degree FROM (SELECT src AS u FROM e UNION ALL SELECT dst FROM e) GROUP BY u) SELECT component, min(degree) >= 2 AS valid, count(*) AS n FROM c JOIN g ON u = node GROUP BY component",
        "cc_refine": f"""{components_sql(f"SELECT src, dst FROM ({COPART}) JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_size = b.p_size")}
SELECT node AS node_id, dense_rank() OVER (ORDER BY component) - 1 AS cluster_id FROM c""",
        "coverage": f"""WITH e AS ({COPART}) SELECT count(*) AS nodes, count(*) AS clustered, (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM e) AS m_in, 1.0::DOUBLE AS node_coverage, 1.0::DOUBLE AS edge_coverage FROM {nodes}""",
        "contingency": f"{comp} SELECT p_size::BIGINT AS a, component AS b, count(*) AS n FROM c JOIN part ON p_partkey = node GROUP BY ALL",
        "cluster_stats": f"""WITH e AS ({COPART}), k AS ({BY_BRAND}), l AS (SELECT ka.cluster_id AS cu, kb.cluster_id AS cv FROM e JOIN k ka ON src = ka.node_id JOIN k kb ON dst = kb.node_id),
s AS (SELECT c, count(*) AS volume, count(*) FILTER (same) AS ends_in FROM (SELECT cu AS c, cu = cv AS same FROM l UNION ALL SELECT cv, cu = cv FROM l) GROUP BY c),
t AS (SELECT k.cluster_id, count(*) AS n FROM k GROUP BY 1),
x AS (SELECT t.*, coalesce(volume, 0) AS volume, coalesce(ends_in, 0) AS ends_in, (SELECT count(*) FROM e) AS m FROM t LEFT JOIN s ON s.c = t.cluster_id)
SELECT cluster_id, n, ends_in // 2 AS m_in, volume - ends_in AS boundary, volume, round(CASE WHEN n > 1 THEN 2 * (ends_in // 2) / (n * (n - 1)) ELSE 0 END, 6) AS density,
round(CASE WHEN least(volume, 2 * m - volume) > 0 THEN (volume - ends_in) / least(volume, 2 * m - volume) ELSE 0 END, 6) AS conductance,
round((ends_in // 2) / m - pow(volume / (2 * m), 2), 6) AS modularity FROM x""",
        "k_valid": k_valid_sql(),
        "ikc_k1": ikc_sql(1),
        "ikc_k2": ikc_sql(2),
        "cluster_cuts": cluster_cuts_sql(),
        "core_numbers": f"WITH RECURSIVE e AS ({COPART}), {cores_sql('e', 'c')} SELECT node, core FROM c",
        "large_components": f"{comp} SELECT component, count(*) AS n FROM c GROUP BY component HAVING count(*) > 10",
        "size_distribution": f"{comp} SELECT count(*) AS clusters, min(n) AS least, round(median(n), 6) AS median, round(avg(n), 6) AS mean, max(n) AS most FROM (SELECT count(*) AS n FROM c GROUP BY component)",
        "cpm_score": f"""WITH e AS ({COPART}), k AS ({BY_BRAND}), i AS (SELECT a.cluster_id, count(*) AS m FROM e JOIN k a ON src = a.node_id JOIN k b ON dst = b.node_id WHERE a.cluster_id = b.cluster_id GROUP BY 1)
SELECT cluster_id, round(coalesce(m, 0) - 0.1::DOUBLE * n * (n - 1) / 2, 6) AS score FROM (SELECT cluster_id, count(*) AS n FROM k GROUP BY 1) LEFT JOIN i USING (cluster_id)""",
        "ami": f"""WITH t AS (SELECT cluster_id AS a, b, count(*) AS n FROM ({BY_BRAND}) JOIN {regroup} USING (node_id) GROUP BY 1, 2),
r AS (SELECT sum(n)::BIGINT AS ra FROM t GROUP BY a), q AS (SELECT sum(n)::BIGINT AS cb FROM t GROUP BY b), z AS (SELECT sum(n)::BIGINT AS N, sum(n * ln(n)) AS hs FROM t),
h AS (SELECT N, ln(N) - (SELECT sum(ra * ln(ra)) FROM r) / N AS ha, ln(N) - (SELECT sum(cb * ln(cb)) FROM q) / N AS hb, ln(N) + (hs - (SELECT sum(ra * ln(ra)) FROM r) - (SELECT sum(cb * ln(cb)) FROM q)) / N AS mi FROM z),
w AS (SELECT ra, cb, N, unnest(range(greatest(1, ra + cb - N), least(ra, cb) + 1)) AS x FROM r, q, z),
y AS (SELECT sum(x / N * ln(N::DOUBLE * x / (ra * cb)) * exp(lgamma(ra + 1) + lgamma(cb + 1) + lgamma(N - ra + 1) + lgamma(N - cb + 1) - lgamma(N + 1) - lgamma(x + 1) - lgamma(ra - x + 1) - lgamma(cb - x + 1) - lgamma(N - ra - cb + x + 1))) AS emi FROM w)
SELECT N AS nodes, round(mi, 6) AS mutual, round(emi, 6) AS expected, round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami FROM h, y""",
        "sbm_entropy_dc": _entropy_sql("dc"),
        "sbm_entropy_ndc": _entropy_sql("ndc"),
        "sbm_entropy_pp": _entropy_sql("pp"),
        "agreement": f"""WITH t AS (SELECT cluster_id AS a, b, count(*) AS n FROM ({BY_BRAND}) JOIN {regroup} USING (node_id) GROUP BY 1, 2),
c AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS hs, sum(n) AS N FROM t),
r AS (SELECT sum(n * (n - 1) / 2) AS ra, sum(n * ln(n)) AS ha FROM (SELECT sum(n)::DOUBLE AS n FROM t GROUP BY a)),
q AS (SELECT sum(n * (n - 1) / 2) AS cb, sum(n * ln(n)) AS hb FROM (SELECT sum(n)::DOUBLE AS n FROM t GROUP BY b))
SELECT N::BIGINT AS nodes, round((s - ra * cb / (N * (N - 1) / 2)) / ((ra + cb) / 2 - ra * cb / (N * (N - 1) / 2)), 6) AS ari,
round(2 * (ln(N) + (hs - ha - hb) / N) / (2 * ln(N) - (ha + hb) / N), 6) AS nmi, round(s / cb, 6) AS precision, round(s / ra, 6) AS recall, round(2 * s / (ra + cb), 6) AS f1,
round((cb - s) / (N * (N - 1) / 2 - ra), 6) AS fpr, round(1 - s / ra, 6) AS fnr FROM c, r, q""",
        "accuracy": f"""WITH e AS ({COPART}), g AS (SELECT node, p_size, (p_size + node % 2) % 20 AS r FROM {nodes} JOIN part ON p_partkey = node),
l AS (SELECT 'c' || p_size AS a, CASE WHEN r % 3 <> 0 THEN 'c' || r ELSE 'n' || node END AS b, r % 3 <> 0 AS known FROM g),
t AS (SELECT 'singletons' AS policy, a, b, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 'intersection', a, b, count(*) FROM l WHERE known GROUP BY ALL),
z AS (SELECT policy, sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS hs, sum(n) AS N FROM t GROUP BY policy),
r AS (SELECT policy, sum(n * (n - 1) / 2) AS ra, sum(n * ln(n)) AS ha FROM (SELECT policy, sum(n)::DOUBLE AS n FROM t GROUP BY policy, a) GROUP BY policy),
q AS (SELECT policy, sum(n * (n - 1) / 2) AS cb, sum(n * ln(n)) AS hb FROM (SELECT policy, sum(n)::DOUBLE AS n FROM t GROUP BY policy, b) GROUP BY policy)
SELECT policy, N::BIGINT AS nodes, round((s - ra * cb / (N * (N - 1) / 2)) / ((ra + cb) / 2 - ra * cb / (N * (N - 1) / 2)), 6) AS ari,
round(2 * (ln(N) + (hs - ha - hb) / N) / (2 * ln(N) - (ha + hb) / N), 6) AS nmi, round(s / cb, 6) AS precision, round(s / ra, 6) AS recall, round(2 * s / (ra + cb), 6) AS f1,
round((cb - s) / (N * (N - 1) / 2 - ra), 6) AS fpr, round(1 - s / ra, 6) AS fnr FROM z JOIN r USING (policy) JOIN q USING (policy)""",
    }
