"""Connected components: tasks contract the edges they hold, alternating large-star and small-star rounds do the rest.

A task reads its edges in chunks of ``HELD`` and hands on a spanning star of each part; what two tasks tell of the same
nodes meets later.  Once at most ``HELD`` edges are left of all, one task ends the work over arrays.

Above that, each round groups edges by one endpoint (partial minimum before the shuffle) and joins the minimum
back, so a node with very many neighbours never sits in one task as a list: the aggregate is
combined map-side and adaptive execution splits the join.  The edge set shrinks towards one star per
component, in about log^2 rounds whatever the diameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.sources.storage import stored

#: Edges that a task contracts together.
HELD = 2_000_000


def least_ends(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of 0..n-1 that the edges connect each of them to."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its part) of all ends, roots with themselves."""
    places, names = pd.factorize(np.concatenate([a, b]), sort=True)
    return names, names[least_ends(places[: len(a)], places[len(a) :], len(names))]


def _forest(batches: Iterator[pa.RecordBatch], held: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows (u, v) to stars (node, root) of the parts they form, ``held`` rows at a time; all at once if ``whole``.

    A root's own row is kept if ``whole``, else only where a loop may be all that names it."""
    had: list[tuple[np.ndarray, np.ndarray]] = []
    rows, types = 0, None

    def stars() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*had, strict=True))
        u, v = _contracted(a, b)
        if whole:
            return u, v
        inner = u != v
        lone = np.setdiff1d(a[a == b], np.concatenate([u[inner], v[inner]]))
        return np.concatenate([u[inner], lone]), np.concatenate([v[inner], lone])

    def batch(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000], types) for x in (u, v)], names=["u", "v"])

    for x in batches:
        types = x.schema.field(0).type
        had.append((x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)))
        rows += x.num_rows
        if rows > held and not whole:
            had = [stars()]
            rows = len(had[0][0])
            if rows > 0.75 * held:  # little is left to contract here
                yield from batch(*had[0])
                had, rows = [], 0
    if rows:
        yield from batch(*stars())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): one star round; returns (u, v) with v the smaller end."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    links = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return links.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every endpoint; the component is its smallest node. Self-loops and null
    ends are allowed: a loop's node is a component of its own if nothing else links it, rows with a
    null end are ignored.  ``edges`` are read once."""
    pairs = edges.select(edges[src].alias("a"), edges[dst].alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    kind = pairs.schema["u"].dataType.simpleString()
    schema = f"u {kind}, v {kind}"
    ends = lambda rows: rows.coalesce(1).mapInArrow(partial(_forest, held=HELD, whole=True), schema).selectExpr("u AS node", "v AS component")  # noqa: E731  # at most HELD rows
    links = stored(pairs.mapInArrow(partial(_forest, held=HELD, whole=False), schema))
    if links.count() <= HELD:
        return stored(ends(links))
    loops = links.where("u = v").select(F.col("u").alias("node")).distinct()
    cur = links.where("u <> v")
    seen = None
    for _ in range(max_rounds):
        nxt = stored(_stars(_stars(cur, True), False))
        state = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        cur = nxt
        if state == seen:
            break
        if state[0] <= HELD:
            cur = stored(ends(cur).where("node <> component").selectExpr("node AS u", "component AS v"))
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    known = found.unionByName(roots)
    alone = loops.join(known, "node", "left_anti")
    return known.unionByName(alone.select("node", F.col("node").alias("component")))
