"""Node sets, degrees, induced subgraphs and labels, as plain DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.sources.storage import stored


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def node_index(edges: DataFrame, *order: str) -> DataFrame:
    """(node, idx): sources in row order first, then new targets; ``order`` names the row's place.

    The rank is taken inside ranges of the order and offset by the ranges before, so no task holds all nodes.
    """
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("side"), place.alias("at")).union(edges.select("dst", F.lit(1), place))
    first = ends.groupBy("node").agg(F.min(F.struct("side", "at")).alias("first"))
    return dense_index(first, ["first", "node"], "idx").select("node", "idx")


def dense_index(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based place of each row in the total order of ``order``, ranked by range partitions.

    The ranges are written once: bounds come from a sample and adaptive execution merges ranges, so a second run may cut elsewhere."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").count()
    ahead = sizes.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_within", within).join(ahead, "_range").withColumn(name, F.col("_within") + F.col("_ahead")).drop("_range", "_within", "_ahead")


def adjacency(edges: DataFrame) -> DataFrame:
    """(u, v): both directions of every edge; a loop gives two rows."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, d_in, d_out, degree), parallel edges counted."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("d_out"))
    in_ = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("d_in"))
    both = out.join(in_, "node", "full").select("node", F.coalesce("d_in", F.lit(0)).alias("d_in"), F.coalesce("d_out", F.lit(0)).alias("d_out"))
    return both.withColumn("degree", F.col("d_in") + F.col("d_out"))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in ``kept`` (node)."""
    return edges.join(kept, edges["src"] == kept["node"], "left_semi").join(kept, F.col("dst") == kept["node"], "left_semi")


def removed(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with no end in ``gone`` (node)."""
    return edges.join(gone, edges["src"] == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti")


def without_singletons(clustering: DataFrame) -> DataFrame:
    big = clustering.where("cluster_id IS NOT NULL").groupBy("cluster_id").count().where("count > 1").select("cluster_id")
    return clustering.join(big, "cluster_id", "left_semi").select("node_id", "cluster_id")


def renumbered(clustering: DataFrame) -> DataFrame:
    """Cluster ids made 0..C-1 in their own order; only the distinct ids are ranked."""
    ids = dense_index(clustering.select("cluster_id").where("cluster_id IS NOT NULL").distinct(), ["cluster_id"], "new_id")
    return clustering.join(ids, "cluster_id").select("node_id", F.col("new_id").cast("long").alias("cluster_id"))


def removed_counts(clustering: DataFrame) -> DataFrame:
    """One row: nodes and clusters that the singleton filter drops and keeps."""
    sizes = clustering.where("cluster_id IS NOT NULL").groupBy("cluster_id").count()
    one = F.col("count") == 1
    return sizes.agg(F.count(F.when(one, 1)).alias("removed_nodes"), F.count(F.when(one, 1)).alias("removed_clusters"), F.count(F.when(~one, 1)).alias("kept_clusters"), F.coalesce(F.sum(F.when(~one, F.col("count"))), F.lit(0)).alias("kept_nodes"))
