"""Edge lists and clusterings: CSV sources, sinks, and the four load profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILES = ("multigraph", "accumulated", "loopless_multi", "simple")


def read_edges(spark: SparkSession, path: str, weighted: bool = False, ordered: bool = False) -> DataFrame:
    """(src, dst, weight) as text ids, by the names source/target if both exist, else by position.

    Ids are never parsed, so ``007`` and ``NA`` stay; a row with an empty end raises.  ``ordered`` adds ``at``, a row's place:
    the file, the block of it, and the row within.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False, nullValue="\u0000", emptyValue="")
    cols = rows.columns
    named = {"source", "target"} <= set(cols)
    src, dst = ("source", "target") if named else cols[:2]
    extra = [c for c in cols if c not in (src, dst)]
    weight = F.col(f"`{extra[0]}`").cast("double") if weighted and extra else F.lit(1.0)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at")
    edges = rows.select(F.col(f"`{src}`").alias("src"), F.col(f"`{dst}`").alias("dst"), weight.alias("weight"), *([place] if ordered else []))
    bad = edges.where("src IS NULL OR dst IS NULL OR src = '' OR dst = ''").count()
    if bad:
        raise ValueError(f"{bad} edges have an empty end")
    return edges


def read_clustering(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="node_id STRING, cluster_id BIGINT")


def write_clustering(clustering: DataFrame, path: str) -> None:
    """CSV with header, ordered by cluster and node; committed as a whole by Spark's committer."""
    clustering.select("node_id", "cluster_id").orderBy("cluster_id", "node_id").write.mode("overwrite").option("header", True).csv(path)


def profile(edges: DataFrame, kind: str) -> DataFrame:
    """Edges as an algorithm loads them; the node set is taken from the edges before this."""
    w = "weight" if "weight" in edges.columns else None
    edges = edges.select("src", "dst", (F.col(w) if w else F.lit(1.0)).alias("weight"))
    if kind == "multigraph":
        return edges
    if kind == "accumulated":
        return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    loopless = edges.where("src <> dst")
    if kind == "loopless_multi":
        return loopless
    if kind == "simple":
        return loopless.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    raise ValueError(f"unknown profile {kind!r}; one of {PROFILES}")
