"""Cluster statistics and agreement measures, as aggregates over two label joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.components import connected_components
from clusterloom.sources.edges import profile
from clusterloom.sources.storage import stored


def _labelled(edges: DataFrame, clustering: DataFrame, simple: bool) -> DataFrame:
    """Simple edges with their ends' clusters; with ``simple`` the edges are pairs with src < dst, each once, and are not told apart again."""
    pairs = (edges if simple else profile(edges, "simple")).select("src", "dst")
    a = clustering.select(F.col("node_id").alias("src"), F.col("cluster_id").alias("cu"))
    b = clustering.select(F.col("node_id").alias("dst"), F.col("cluster_id").alias("cv"))
    return pairs.join(a, "src", "left").join(b, "dst", "left")


def cluster_stats(edges: DataFrame, clustering: DataFrame, simple: bool = False) -> DataFrame:
    """(cluster_id, n, m_in, boundary, volume, density, conductance, modularity) of every cluster."""
    ends = _labelled(edges, clustering, simple)
    m = ends.agg(F.count(F.lit(1)).alias("m"))
    same = F.col("cu").eqNullSafe(F.col("cv"))
    sides = ends.select(F.col("cu").alias("cluster_id"), same.alias("same")).union(ends.select("cv", same))
    sums = sides.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("volume"), F.count(F.when(F.col("same"), 1)).alias("ends_in"))
    sizes = clustering.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    t = sizes.join(sums, "cluster_id", "left").fillna(0, ["volume", "ends_in"]).join(F.broadcast(m))  # one row
    m_in = (F.col("ends_in") / 2).cast("long")
    out = F.col("volume") - F.col("ends_in")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return t.select(
        "cluster_id", "n", m_in.alias("m_in"), out.alias("boundary"), "volume",
        F.round(ratio(2 * m_in, F.col("n") * (F.col("n") - 1)), 6).alias("density"),
        F.round(ratio(out, F.least(F.col("volume"), 2 * F.col("m") - F.col("volume"))), 6).alias("conductance"),
        F.round(ratio(m_in, F.col("m")) - F.pow(ratio(F.col("volume"), 2 * F.col("m")), 2), 6).alias("modularity"),
    )


def coverage(edges: DataFrame, clustering: DataFrame, simple: bool = False) -> DataFrame:
    """One row: share of nodes that have a cluster and of edges within one."""
    ends = _labelled(edges, clustering, simple)
    inner = ends.agg(F.count(F.when(F.col("cu") == F.col("cv"), 1)).alias("m_in"), F.count(F.lit(1)).alias("m"))
    every = edges.select("src").union(edges.select("dst")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    have = clustering.agg(F.count(F.lit(1)).alias("clustered"))
    one = inner.join(F.broadcast(every)).join(F.broadcast(have))  # one row each
    return one.select("nodes", "clustered", "m", "m_in", F.round(F.col("clustered") / F.col("nodes"), 6).alias("node_coverage"), F.round(F.col("m_in") / F.col("m"), 6).alias("edge_coverage"))


def cluster_components(edges: DataFrame, clustering: DataFrame, simple: bool = False) -> DataFrame:
    """(cluster_id, n, components): nodes of every cluster and connected parts that its inner edges leave, lone nodes included."""
    inner = _labelled(edges, clustering, simple).where("cu = cv").select("src", "dst")
    parts = clustering.join(connected_components(inner), F.col("node_id") == F.col("node"), "left")
    return parts.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("component") + F.count(F.when(F.col("component").isNull(), 1))).alias("components"))


def contingency(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, n) over the nodes that both label."""
    t = truth.select("node_id", F.col("cluster_id").alias("a"))
    return t.join(found.select("node_id", F.col("cluster_id").alias("b")), "node_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def agreement(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: N, ARI, NMI, pair precision, recall, F1, false positive and false negative rate over the
    common nodes.  Rates without a pair to judge are 0, the other ratios 1."""
    table = contingency(truth, found)
    pairs = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0))
    plogp = lambda c: F.sum(F.col(c) * F.log(c))
    cells = table.agg(pairs("n").alias("s"), plogp("n").alias("hs"), F.sum("n").alias("N"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs("n").alias("ra"), plogp("n").alias("ha"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs("n").alias("cb"), plogp("n").alias("hb"))
    t = cells.join(F.broadcast(rows)).join(F.broadcast(cols))  # one row each
    s, a, b, n = (F.col(c) for c in ("s", "ra", "cb", "N"))
    total = n * (n - 1) / 2
    chance = F.when(total > 0, a * b / total).otherwise(0.0)
    ari = F.when((a + b) / 2 == chance, 1.0).otherwise((s - chance) / ((a + b) / 2 - chance))
    ha, hb = F.log("N") - F.col("ha") / n, F.log("N") - F.col("hb") / n
    mi = F.log("N") + (F.col("hs") - F.col("ha") - F.col("hb")) / n
    nmi = F.when(F.abs(ha + hb) < 1e-12, 1.0).otherwise(2 * mi / (ha + hb))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(1.0)
    r = lambda c, name: F.round(c, 6).alias(name)
    return t.select(F.coalesce(n, F.lit(0)).cast("long").alias("nodes"), r(ari, "ari"), r(F.coalesce(nmi, F.lit(1.0)), "nmi"), r(ratio(s, b), "precision"), r(ratio(s, a), "recall"), r(ratio(2 * s, a + b), "f1"), r(F.when(total > a, (b - s) / (total - a)).otherwise(0.0), "fpr"), r(1 - ratio(s, a), "fnr"))


def filled(nodes: DataFrame, clustering: DataFrame) -> DataFrame:
    """Every one of ``nodes`` (node) with a cluster id as text; one without a cluster is a cluster of its own."""
    known = clustering.where("cluster_id IS NOT NULL").select("node_id", F.concat(F.lit("c"), F.col("cluster_id").cast("string")).alias("c"))
    every = nodes.select(F.col("node").alias("node_id")).join(known, "node_id", "left")
    return every.select("node_id", F.coalesce("c", F.concat(F.lit("n"), F.col("node_id").cast("string"))).alias("cluster_id"))


def accuracy(nodes: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """Agreement under both policies for nodes that a clustering leaves out: ``intersection`` compares
    the nodes that both label, ``singletons`` makes each such node of ``nodes`` a cluster of its own."""
    common = agreement(truth, found).withColumn("policy", F.lit("intersection"))
    return common.unionByName(agreement(filled(nodes, truth), filled(nodes, found)).withColumn("policy", F.lit("singletons")))


#: Sizes of either side fall into this many buckets; every pair of buckets is a key of its own where all pairs of sizes meet.
SIZE_BUCKETS = 16
#: Cells of a table with fixed margins that are this unlikely together (natural log) are below what doubles tell apart.
UNLIKELY = 80.0


def expected_information(rows: DataFrame, cols: DataFrame, total: DataFrame) -> DataFrame:
    """One row (emi): the mean mutual information of clusterings drawn with the cluster sizes given.

    ``rows`` (ra, ka) and ``cols`` (cb, kb) are distinct sizes and their numbers of clusters, ``total`` one row (N).
    A cell of clusters of a and b nodes is hypergeometric.  Its terms go by their ratios outwards from the likeliest
    value and are divided by their sum, so nothing of the size of N! is ever subtracted.  The cell is a sum of
    independent draws, so by Bernstein's bound values further off than the reach below have a mass under 2 exp(-``UNLIKELY``);
    the reach grows like the root of N.  No sizes give 0."""
    spread = lambda t, size, mine, other: t.withColumn(mine, F.expr(f"pmod(xxhash64({size}), {SIZE_BUCKETS})")).withColumn(other, F.explode(F.expr(f"sequence(0L, {SIZE_BUCKETS - 1}L)")))
    pairs = spread(rows, "ra", "i", "j").join(spread(cols, "cb", "j", "i"), ["i", "j"]).join(F.broadcast(total))  # one row
    pairs = pairs.selectExpr("ka * kb AS k", "double(ra) AS a", "double(cb) AS b", "double(N) AS n")
    pairs = pairs.selectExpr("*", "n / (a * b) AS c", "greatest(0D, a + b - n) AS lo", "least(a, b) AS hi", "CASE WHEN n > 1 THEN (a / n) * b * ((n - a) / n) * ((n - b) / (n - 1)) ELSE 0D END AS var")
    reach = f"ceil({UNLIKELY / 3}D + sqrt({UNLIKELY * UNLIKELY / 9}D + {2 * UNLIKELY}D * var))"
    pairs = pairs.selectExpr("*", "least(hi, greatest(lo, floor((a + 1) * ((b + 1) / (n + 2))))) AS top", f"{reach} AS reach")
    up = "(a - x + 1) / x * ((b - x + 1) / (n - a - b + x))"
    down = "(x + 1) / (a - x) * ((n - a - b + x + 1) / (b - x))"
    value = "CASE WHEN x > 0 THEN x * ln(x * c) ELSE 0D END"

    def tail(first: str, last: str, step: int, ratio: str) -> str:
        at = f"CASE WHEN {step} * ({last} - {first}) >= 0 THEN sequence(bigint({first}), bigint({last}), {step}L) ELSE array() END"
        each = f"transform(array(double(q)), x -> named_struct('r', {ratio}, 'f', {value}))[0]"
        return (
            f"aggregate(transform({at}, q -> {each}), named_struct('u', 1D, 'p', 0D, 's', 0D),"
            " (t, e) -> named_struct('u', t.u * e.r, 'p', t.p + t.u * e.r, 's', t.s + t.u * e.r * e.f))"
        )

    sums = pairs.selectExpr("k", "n", f"transform(array(top), x -> {value})[0] AS f", f"{tail('(top + 1)', 'least(hi, top + reach)', 1, up)} AS above", f"{tail('(top - 1)', 'greatest(lo, top - reach)', -1, down)} AS below")
    return sums.agg(F.expr("coalesce(sum(k / n * (f + above.s + below.s) / (1 + above.p + below.p)), 0D) AS emi"))


def adjusted_information(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row (nodes, mutual, expected, ami) over the common nodes; two trivial equal clusterings give 1.

    The expected information depends on cluster sizes only, so it is summed once for each pair of
    distinct sizes; those are at most sqrt(2 N) on each side.
    """
    table = stored(contingency(truth, found))
    plogp = lambda c: F.sum(F.col(c) * F.log(c))
    cells = table.agg(plogp("n").alias("hs"), F.sum("n").alias("N"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).groupBy(F.col("n").alias("ra")).agg(F.count(F.lit(1)).alias("ka"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n")).groupBy(F.col("n").alias("cb")).agg(F.count(F.lit(1)).alias("kb"))
    entropy = lambda t, size, k, name: t.agg(F.sum(F.col(k) * F.col(size) * F.log(size)).alias(name))
    one = cells.join(F.broadcast(entropy(rows, "ra", "ka", "ha"))).join(F.broadcast(entropy(cols, "cb", "kb", "hb")))  # one row each
    t = one.join(F.broadcast(expected_information(rows, cols, cells.select("N"))))  # one row
    total = F.col("N")
    ha, hb = F.log("N") - F.col("ha") / total, F.log("N") - F.col("hb") / total
    mi = F.log("N") + (F.col("hs") - F.col("ha") - F.col("hb")) / total
    room = (ha + hb) / 2 - F.col("emi")
    r = lambda c, name: F.round(c, 6).alias(name)
    return t.select(total.cast("long").alias("nodes"), r(mi, "mutual"), r(F.col("emi"), "expected"), r(F.when(F.abs(room) < 1e-12, 1.0).otherwise((mi - F.col("emi")) / room), "ami"))


def size_distribution(clustering: DataFrame) -> DataFrame:
    """One row (clusters, least, median, mean, most) of the cluster sizes; no clusters give nulls."""
    n = clustering.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("clusters"), F.min("n").alias("least"), F.round(F.median("n"), 6).alias("median"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


def cpm_score(edges: DataFrame, clustering: DataFrame, gamma: float, simple: bool = False) -> DataFrame:
    """(cluster_id, score): edges within less ``gamma`` times the pairs of nodes."""
    s = cluster_stats(edges, clustering, simple)
    return s.select("cluster_id", F.round(F.col("m_in") - gamma * F.col("n") * (F.col("n") - 1) / 2, 6).alias("score"))


def best_model(models: DataFrame) -> DataFrame:
    """The (ord, model, entropy) row of least entropy; the first wins ties, NaN never wins."""
    best = models.where("entropy IS NOT NULL AND NOT isnan(entropy)").agg(F.min(F.struct("entropy", "ord", "model")).alias("m"))
    return best.select("m.model", "m.entropy")
