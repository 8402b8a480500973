"""Connected components dealt to bins that one task holds, and what a task asks of such a bin's edges."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.components import connected_components
from clusterloom.operators.components import least_ends as roots
from clusterloom.sources.storage import stored

#: Edges of the components that share a bin, about.
BIN_EDGES = 500_000


def dealt(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(src, dst, bin) of the components of at most ``most`` edges, and (src, dst) of the larger ones or None if there are none.

    A component is whole in its bin; small ones share bins.  ``edges`` (src, dst) are read several times."""
    if most <= 0:
        return edges.withColumn("bin", F.lit(0)).limit(0), edges
    parts = stored(connected_components(edges))
    named = edges.join(parts.withColumnRenamed("node", "src"), "src")
    sizes = stored(named.groupBy("component").agg(F.count(F.lit(1)).alias("m")))
    total, large = sizes.agg(F.coalesce(F.sum(F.when(F.col("m") <= most, F.col("m"))), F.lit(0)), F.count(F.when(F.col("m") > most, 1))).first()
    bins = math.ceil(total / BIN_EDGES) or 1
    alone = F.xxhash64("component", F.lit(1))  # no other component of this size falls there but by a chance of 2^-64
    held = sizes.where(F.col("m") <= most).select("component", F.when(F.col("m") > BIN_EDGES / 2, alone).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins))).alias("bin"))
    small = named.join(held, "component").select("src", "dst", "bin").repartition(4 * bins, "bin")
    return small, named.join(sizes.where(F.col("m") > most), "component").select("src", "dst") if large else None


def streamed(rows: DataFrame, key: str, columns: list[str], once: list[str], solve: Callable[..., list], schema: str) -> DataFrame:
    """``solve`` of the rows of each ``key``, which lie together in the partitions of ``rows``, in the order of the keys.

    It gets arrays of ``columns`` and the first value of those of ``once``, and gives arrays of ``schema``.  A key's rows are read batch by
    batch into arrays of these columns, so that a task holds neither a table of them nor the key's copies."""
    at = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, first, found, rows_found = [[] for _ in columns], None, [], [], 0

        def ended() -> list:
            parts = []
            for x in held:
                parts.append(np.concatenate(x) if len(x) > 1 else x[0])
                x.clear()
            return solve(*parts, *first)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=at)

        for x in batches:
            keys = x.column(key).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            arrays = [x.column(c).to_numpy(zero_copy_only=False) for c in columns]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held[0] and keys[lo] != now:
                    found.append(ended())
                    rows_found += len(found[-1][0])
                    if rows_found > 100_000:
                        yield batch()
                        found, rows_found = [], 0
                if not held[0]:
                    now, first = keys[lo], [x.column(c)[lo].as_py() for c in once]
                for h, y in zip(held, arrays, strict=True):
                    h.append(y[lo:hi].copy())
        if held and held[0]:
            found.append(ended())
        if found:
            yield batch()

    return rows.sortWithinPartitions(key).select(key, *columns, *once).mapInArrow(run, schema)


def numbered(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names in order, and each edge's ends as places in them."""
    places, names = pd.factorize(np.concatenate([src, dst]), sort=True)
    places = places.astype(np.int32)
    return names, places[: len(src)], places[len(src) :]


def numbered_ends(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names in order, and each edge's ends as places in them."""
    places, names = pd.factorize(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), sort=True)
    return names, places[: len(pdf)], places[len(pdf) :]


def neighbours(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, near, edge): the neighbours of i are near[first[i]:first[i + 1]], by the edges ``edge``."""
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
    near = np.concatenate([b, a])[order]
    order %= max(1, len(a))
    return first, near, order


def spans(first: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The places of all neighbours of ``nodes``."""
    size = first[nodes + 1] - first[nodes]
    return np.repeat(first[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())


def peel(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Core number of each of n nodes, parallel edges counted; loops are not among the edges."""
    first, near, _ = neighbours(a, b, n)
    degree, core = np.diff(first), np.zeros(n, np.int64)
    alive, left, k = np.ones(n, bool), np.arange(n), 0
    while left.size:
        k = max(k, degree[left].min())
        front = left[degree[left] <= k]
        while front.size:
            core[front], alive[front] = k, False
            hit = near[spans(first, front)]
            touched, times = np.unique(hit[alive[hit]], return_counts=True)
            degree[touched] -= times
            front = touched[degree[touched] <= k]
        left = left[alive[left]]
    return core


def innermost_parts(a: np.ndarray, b: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, part, core) of the iterative k-core: in every component the innermost core's connected parts, named by their least
    node, are taken off until its core number falls below k.  Components do not tell on each other, so all go at once."""
    found = [np.zeros((3, 0), np.int64)]
    at = np.arange(n)
    component = roots(a, b, n)
    while len(a):
        core = peel(a, b, len(at))
        top = np.zeros(n, np.int64)
        np.maximum.at(top, component, core)
        inner = (core == top[component]) & (core >= max(k, 1))
        both = inner[a] & inner[b]
        part = roots(a[both], b[both], len(at))
        found.append(np.stack([at[inner], at[part[inner]], core[inner]]))
        stays = ~inner & (top[component] >= max(k, 1))
        kept = stays[a] & stays[b]
        place = np.cumsum(stays) - 1
        a, b, at, component = place[a[kept]], place[b[kept]], at[stays], component[stays]
    return tuple(np.concatenate(found, axis=1))
