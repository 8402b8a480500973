"""Core numbers and iterative k-core clustering: components that a task holds are peeled there, larger ones by joins.

By joins core numbers take h-index rounds, with trees and chains folded where rounds are many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.operators.bins import dealt, innermost_parts, numbered_ends, peel
from clusterloom.operators.components import connected_components
from clusterloom.operators.graph import adjacency, dense_index, induced, nodes, removed
from clusterloom.sources.edges import profile
from clusterloom.sources.storage import stored


#: Rounds after which trees and chains are folded: a value crosses one link a round.
PATIENCE = 30
#: Edges of a component that one task peels at most.
IN_TASK_EDGES = 2_500_000
#: Nodes whose values every task holds at most, four bytes each; a graph of more nodes, or of nodes that are no numbers, takes joined rounds.
HELD_NODES = 50_000_000
#: Rounds over held values after which trees and chains are folded.
HELD_ROUNDS = 200


def _h_index(links: DataFrame, rounds: int | None = None, upper: DataFrame | None = None, touched: DataFrame | None = None) -> DataFrame | None:
    """(node, core) of (u, v) links in both directions, or None if ``rounds`` are not enough.

    Values start at the degree, or at ``upper`` (node, most) where that is less (or ``touched`` is given), and a node takes
    the h-index of its neighbours' values, until none falls.  Neighbours are counted by value before they
    are ranked, so a hub's list is no longer than the values that occur around it.

    A round reads the links of those nodes only whose value may be broken: at first all, or those of ``touched`` (node), which is
    right where ``upper`` holds for the others; then nodes beside one that fell from no less than their value to below it."""
    state = links.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("core"))
    if upper is not None:
        start = F.least("core", "most") if touched is None else F.coalesce("most", "core")  # a fall before the first round would not be told on
        state = state.join(upper, "node", "left").select("node", start.alias("core"))
    state = stored(state)
    work = links if touched is None else links.join(touched.select(F.col("node").alias("u")), "u", "left_semi")
    done = 0
    while rounds is None or done < rounds:
        done += 1
        seen = work.join(state.select(F.col("node").alias("v"), "core"), "v").groupBy("u", "core").agg(F.count(F.lit(1)).alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("u").orderBy(F.desc("core")))
        h = seen.withColumn("reach", F.least(at_least, F.col("core"))).groupBy(F.col("u").alias("node")).agg(F.max("reach").alias("new"))
        now = F.least("core", "new")  # nodes outside the work have no new value
        nxt = stored(state.join(h, "node", "left").select("node", now.alias("core"), F.col("core").alias("was"), (now < F.col("core")).alias("moved")))
        fell = nxt.where("moved").selectExpr("node AS u", "core AS new", "was")
        state = nxt.select("node", "core")
        if fell.isEmpty():
            return state
        beside = links.join(fell, "u").select("v", "new", "was")
        broken = beside.join(state.withColumnRenamed("node", "v"), "v").where("new < core AND core <= was").select(F.col("v").alias("u"))
        work = links.join(broken, "u", "left_semi")
    return None


def fallen(first: np.ndarray, near: np.ndarray, own: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, h-index) of those nodes ``own`` whose value is above the h-index of their neighbours' values.

    The neighbours of own[i] are near[first[i]:first[i + 1]], at least one."""
    mine, around = value[own], value[near]
    broken = np.flatnonzero(np.add.reduceat(around >= np.repeat(mine, np.diff(first)), first[:-1], dtype=np.int64) < mine)
    if not broken.size:
        return broken, broken
    size = np.diff(first)[broken]
    start = np.cumsum(size) - size
    rows = np.repeat(np.arange(len(broken)), size)
    at = np.repeat(first[broken] - start, size) + np.arange(size.sum())
    order = np.lexsort((-around[at], rows))
    place = np.arange(len(order)) - start[rows] + 1
    return broken, np.maximum.reduceat(np.minimum(around[at][order], place), start)


def _held_h_index(links: DataFrame, upper: DataFrame | None = None) -> DataFrame | None:
    """``_h_index`` with the values of all nodes in every task: a round reads each node's neighbours, written once as a list, and sends on
    what fell.  None if the nodes are too many or no numbers, or if ``HELD_ROUNDS`` are not enough."""
    spark, kind = links.sparkSession, links.schema["u"].dataType.simpleString()
    if kind not in ("int", "bigint"):
        return None
    degree = stored(links.groupBy("u").agg(F.count(F.lit(1)).cast("int").alias("n")))
    if degree.count() > HELD_NODES:
        return None
    every = degree.toArrow()
    names, value = every.column("u").to_numpy(), every.column("n").to_numpy().astype(np.int32)
    order = np.argsort(names)
    names, value = names[order], value[order]
    if upper is not None:
        most = upper.join(degree, upper["node"] == degree["u"], "left_semi").toArrow()
        at = np.searchsorted(names, most.column("node").to_numpy())
        value[at] = np.minimum(value[at], most.column("most").to_numpy())
    known = spark.sparkContext.broadcast(names)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, near) of rows (u, v) in the order of u, some rows at a time: one node's list may come in parts."""
        for x in batches:
            u, v = (np.searchsorted(known.value, x.column(i).to_numpy()).astype(np.int32) for i in (0, 1))
            if len(u):
                first = np.concatenate([[0], np.flatnonzero(u[1:] != u[:-1]) + 1])
                ends = pa.array(np.append(first, len(u)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(u[first]), pa.ListArray.from_arrays(ends, pa.array(v))], names=["id", "near"])

    parts = links.sparkSession.sparkContext.defaultParallelism * 2
    rows = links.repartition(max(parts, int(value.sum(dtype=np.int64) // 4_000_000) + 1), "u").sortWithinPartitions("u").select("u", "v")
    table = stored(rows.mapInArrow(lists, "id int, near array<int>").groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near")))
    for _ in range(HELD_ROUNDS):
        held = spark.sparkContext.broadcast(value)

        def judged(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if x.num_rows:
                    own, near = x.column(0).to_numpy(), x.column(1)
                    at, new = fallen(near.offsets.to_numpy().astype(np.int64) - near.offsets[0].as_py(), near.flatten().to_numpy(), own, held.value)
                    yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(new.astype(np.int32))], names=["id", "core"])

        fell = table.mapInArrow(judged, "id int, core int").toArrow()
        held.unpersist()
        if not fell.num_rows:
            rows = ((int(lo), int(min(lo + 100_000, len(names)))) for lo in range(0, len(names), 100_000))
            final = spark.sparkContext.broadcast(value)

            def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for x in batches:
                    for lo, hi in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                        yield pa.RecordBatch.from_arrays([pa.array(known.value[lo:hi]), pa.array(final.value[lo:hi].astype(np.int64))], names=["node", "core"])

            return stored(spark.createDataFrame(list(rows), "lo long, hi long").mapInArrow(told, f"node {kind}, core long"))
        value = value.copy()
        value[fell.column("id").to_numpy()] = fell.column("core").to_numpy()
    return None


def _folded(links: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Links whose nodes all have two or more, and no two nodes of degree two side by side.

    Leaves go, and a chain of nodes of degree two becomes its smallest node, until neither is left; trees and
    long paths so take rounds by the logarithm of their size.  Also returned: (node, rep) of chains,
    one table for each round, and (node, core) of the cycles that chains closed to."""
    chains: list[DataFrame] = []
    cycles: list[DataFrame] = []
    while True:
        degree = stored(links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n <= 2"))
        two = degree.where("n = 2").select("u")
        pairs = stored(links.join(two, "u", "left_semi").join(two.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v"))
        leaves = degree.where("n = 1").select("u")
        chained, leafy = not pairs.isEmpty(), not leaves.isEmpty()
        if not chained and not leafy:
            return links, chains, cycles
        if chained:
            parts = stored(connected_components(pairs, "u", "v"))
            inner = pairs.join(parts.select(F.col("node").alias("u"), "component"), "u").groupBy("component").agg(F.count(F.lit(1)).alias("links"))
            whole = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(inner, "component").where("links = 2 * n").select("component")
            cycles.append(parts.join(whole, "component").select("node", F.lit(2).cast("long").alias("core")))
            chains.append(parts.where("node <> component").join(whole, "component", "left_anti").select("node", F.col("component").alias("rep")))
            a = parts.select(F.col("node").alias("u"), F.col("component").alias("cu"))
            b = parts.select(F.col("node").alias("v"), F.col("component").alias("cv"))
            both = links.join(a, "u", "left").join(b, "v", "left").where("cu IS NULL OR cv IS NULL OR cu <> cv")
            links = both.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
        if leafy:
            links = links.join(leaves, "u", "left_anti").join(leaves.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v")
        links = stored(links)


def core_numbers(edges: DataFrame, upper: DataFrame | None = None, touched: DataFrame | None = None) -> DataFrame:
    """(node, core) with in+out degree, parallel edges counted, loops ignored; with ``upper`` by the joined rounds (``_joined_cores``)."""
    if upper is not None:
        return _joined_cores(edges, upper, touched)
    node = edges.schema["src"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, a, b = numbered_ends(pdf)
        return pd.DataFrame({"node": names, "core": peel(a, b, len(names))})

    links = stored(edges.where("src <> dst").select("src", "dst"))
    if links.count() > IN_TASK_EDGES and (found := _held_h_index(adjacency(links))) is not None:  # it needs no components
        lone = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(found, "node", "left_anti")
        return found.unionByName(lone.withColumn("core", F.lit(0).cast("long")))
    small, large = dealt(links, IN_TASK_EDGES)
    found = small.groupBy("bin").applyInPandas(solve, f"node {node}, core long")
    if large is not None:
        found = found.unionByName(_joined_cores(large))
    alone = edges.where("src = dst").select(F.col("src").alias("node"), F.lit(0).cast("long").alias("core"))
    return found.unionByName(alone).groupBy("node").agg(F.max("core").alias("core"))  # a loop's node has core 0 if it has nothing else


def _joined_cores(edges: DataFrame, upper: DataFrame | None = None, touched: DataFrame | None = None) -> DataFrame:
    """``core_numbers`` of a graph that no task holds.  ``upper`` (node, most): known upper bounds,
    with ``touched`` (node) the cores before some links went, and the nodes that lost links.

    Where ``PATIENCE`` rounds do not settle the values, trees and chains are folded first: what that removes has core 1,
    a chain that stays has its representative's core (2 at most, for it has two links).  Both ways give the same cores."""
    links = stored(adjacency(edges.where("src <> dst")))
    if (cores := _held_h_index(links, upper)) is not None:
        lone = nodes(edges.where("src = dst")).join(cores, "node", "left_anti")
        return cores.unionByName(lone.withColumn("core", F.lit(0).cast("long")))
    every = nodes(edges)
    cores = _h_index(links, PATIENCE, upper, touched)
    if cores is None:
        rest, chains, cycles = _folded(links)
        cores = _h_index(rest)
        for part in cycles:
            cores = cores.unionByName(part)
        for rep in reversed(chains):
            cores = stored(cores)
            cores = cores.unionByName(rep.join(cores.withColumnRenamed("node", "rep"), "rep").select("node", "core"))
    linked = links.select(F.col("u").alias("node"), F.lit(1).alias("one")).distinct()
    known = every.join(stored(cores), "node", "left").join(linked, "node", "left")
    return known.select("node", F.coalesce("core", "one", F.lit(0)).cast("long").alias("core"))


def _neighbours(edges: DataFrame, some: DataFrame) -> DataFrame:
    """(node) outside ``some`` (node) that has an edge to one of them."""
    beside = adjacency(edges).join(some.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node")).distinct()
    return beside.join(some, "node", "left_anti")


def _levels_in_tasks(small: DataFrame, node: str, k: int) -> DataFrame:
    """(node, component, k) of the components that share ``bin``."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, a, b = numbered_ends(pdf)
        at, part, core = innermost_parts(a, b, len(names), k)
        return pd.DataFrame({"node": names[at], "component": names[part], "k": core})

    return small.groupBy("bin").applyInPandas(solve, f"node {node}, component {node}, k int")


def iterative_k_core(edges: DataFrame, k: int = 0, index: DataFrame | None = None) -> DataFrame:
    """(node_id, cluster_id, k): components of the innermost core, taken off, until cores fall below k.

    Clusters are numbered by core number downwards, then by the first node of ``index`` (node, idx; as
    ``graph.node_index`` makes it from an edge list's order), without one by smallest node; singletons are dropped.
    """
    node = edges.schema["src"].dataType.simpleString()
    links = stored(profile(edges, "loopless_multi").select("src", "dst"))
    if links.count() > IN_TASK_EDGES and node in ("int", "bigint"):  # the first core is taken off before components are told apart
        found = _joined_levels(links, k)
    else:
        small, large = dealt(links, IN_TASK_EDGES)
        found = _levels_in_tasks(small, node, k)
        if large is not None:
            found = found.unionByName(_joined_levels(stored(large), k))
    found = stored(found)
    placed = found.withColumn("at", F.col("component")) if index is None else found.join(index.select("node", F.col("idx").alias("at")), "node")
    groups = placed.groupBy("component", "k").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).where("n > 1").withColumn("down", -F.col("k"))
    ids = dense_index(groups, ["down", "at"], "cluster_id")
    return found.join(ids.select("component", "cluster_id"), "component").select(F.col("node").alias("node_id"), F.col("cluster_id").cast("long").alias("cluster_id"), "k")


def _joined_levels(left: DataFrame, k: int) -> DataFrame:
    """(node, component, k): the components of ``iterative_k_core`` of a graph that no task holds; what a core leaves over goes to tasks where it fits."""
    node = left.schema["src"].dataType.simpleString()
    found, upper, touched = left.sparkSession.createDataFrame([], f"node {node}, component {node}, k int"), None, None
    while True:
        cores = stored(_joined_cores(left, upper, touched))
        upper = cores.select("node", F.col("core").alias("most"))  # taking nodes off raises no core
        top = cores.agg(F.max("core")).first()[0]
        if top is None or top < max(k, 1):
            return found
        inner = cores.where(F.col("core") == top).select("node")
        parts = connected_components(induced(left, inner)).withColumn("k", F.lit(int(top)))
        found = found.unionByName(parts)
        touched = stored(_neighbours(left, inner))
        small, rest = dealt(stored(removed(left, inner)), IN_TASK_EDGES)
        found = found.unionByName(stored(_levels_in_tasks(small, node, k)))
        if rest is None:
            return found
        left = stored(rest)
