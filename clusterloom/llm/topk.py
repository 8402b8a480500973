"""Exact top-k by inner product: a KD-tree for each shard, best-first with propagated bounds.

Rows are dealt to shards of at most about ``SHARD`` vectors by hash, smaller ones where cores would idle.  A shard's task builds a KD-tree
(median splits on the widest side, leaves of ``LEAF``, tight boxes) and writes it as one row.  Queries
come in blocks of about ``BLOCK``.  Both are written in the narrowest integers that hold their components, for every block
visits every shard: bytes moved are pairs of tiles times their size, and larger tiles move less.  Each block first searches one shard; the k-th score it finds there goes
with the block to all other shards, where it cuts every box whose bound is below.  Inside a tree all
queries of a block walk at once: in each round a query opens the box with its highest bound, which is
either split or, at a leaf, scored by one matrix product with the other queries at that leaf.

Equal vectors of a shard are one point with its k + 1 smallest ids, which is all that k results and
the query's own exclusion can need, so copies neither deepen the tree nor widen the result.

Defined cases: vectors that are null or hold a null or non-finite component take no part; shorter
vectors are padded with zeros; ties go to the smaller id, null ids last; repeated rows are rows of
their own and only the query's own row is left out; empty tables give empty results.  Scores are
exact in 64 bits: where a sum of products may leave the mantissa of a double, components are multiplied in halves of
``LIMB`` bits, and box bounds are widened by their rounding.  Extra columns are never read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterloom.sources.storage import stored

SHARD = 1 << 16
BLOCK = 1 << 13
LEAST_SHARD, LEAST_BLOCK = 1 << 12, 1 << 8
LEAF = 256
RANK_BITS = 18  # places inside a shard, for ties; hashing deals no shard four times the mean
LIMB = 20
NOTHING = np.iinfo(np.int64).min


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _narrow(points: np.ndarray) -> np.ndarray:
    most = int(abs(points).max(initial=0))
    return points.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return dict(f)


def _matrix(column, dims: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), dims), np.int64)
    for row, x in zip(out, rows, strict=True):
        row[: len(x)] = x
    return out


def build_tree(ids: np.ndarray, uids: np.ndarray, points: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Arrays of a tree over one shard: points in leaf order, node boxes, children and ranges."""
    order = np.lexsort((uids, ids))
    ids, uids, points = ids[order], uids[order], points[order]
    _, group = np.unique(points, axis=0, return_inverse=True)
    group = group.reshape(-1)
    by_group = np.argsort(group, kind="stable")
    g = group[by_group]
    begin = np.concatenate(([True], g[1:] != g[:-1]))
    place = np.arange(len(g)) - np.maximum.accumulate(np.where(begin, np.arange(len(g)), 0))
    keep = np.sort(by_group[place <= k])
    ids, uids, points = ids[keep], uids[keep], points[keep]
    order = np.arange(len(ids))
    nodes: list[list[int]] = [[0, len(ids), -1, -1]]
    lo, hi = [], []
    at = 0
    while at < len(nodes):
        a, b = nodes[at][:2]
        own = points[order[a:b]]
        low, high = own.min(0), own.max(0)
        lo.append(low)
        hi.append(high)
        side = int(np.argmax(high - low))
        if b - a > LEAF and high[side] > low[side]:
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], middle)]
            nodes[at][2:] = len(nodes), len(nodes) + 1
            nodes += [[a, a + middle, -1, -1], [a + middle, b, -1, -1]]
        at += 1
    return {"ids": ids[order], "uids": uids[order], "rank": order, "points": _narrow(points[order]), "nodes": np.array(nodes), "lo": np.array(lo, np.float64), "hi": np.array(hi, np.float64)}


def search(tree: dict[str, np.ndarray], queries: np.ndarray, quids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query place, point place, score) as two arrays: keys of the best k of each query, and scores.

    ``least``: scores below are of no use, by an earlier shard's k-th score.
    """
    nodes, points = tree["nodes"], tree["points"].astype(np.float64)
    q = queries.astype(np.float64)
    size = max(abs(q).max(initial=0), 1) * max(abs(points).max(initial=0), 1) * max(q.shape[1], 1)
    packed = size < 2.0 ** (62 - RANK_BITS)  # score and tie in one number
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = 0.0 if size < 2.0**50 else size * 2.0**-48
    bounds = np.minimum(up @ tree["hi"].T + down @ tree["lo"].T + slack, 2.0**62).astype(np.int64)
    score_of = (lambda at, a, b: (q[at] @ points[a:b].T).astype(np.int64)) if size < 2.0**52 else partial(_in_limbs, queries.astype(np.int64), tree["points"].astype(np.int64))
    own = {int(u): i for i, u in enumerate(tree["uids"])}
    mine = np.array([own.get(int(u), -1) for u in quids])
    tie = (1 << RANK_BITS) - 1 - tree["rank"]
    best = np.full((len(q), k), NOTHING, np.int64)  # packed, or scores with their ties beside them
    ties = np.zeros((0 if packed else len(q), k), np.int64)
    open_ = np.full(bounds.shape, NOTHING, np.int64)
    open_[:, 0] = bounds[:, 0]
    active = np.arange(len(q))
    while len(active):
        node = open_[active].argmax(1)
        bound = open_[active, node]
        worst = best[active].min(1)
        kth = np.where(worst == NOTHING, NOTHING, worst >> RANK_BITS if packed else worst)
        going = (bound != NOTHING) & (bound >= np.maximum(kth, least[active]))
        active, node = active[going], node[going]
        open_[active, node] = NOTHING
        for n in np.unique(node):
            at = active[node == n]
            a, b, left, right = nodes[n]
            if left >= 0:
                open_[at, left], open_[at, right] = bounds[at, left], bounds[at, right]
                continue
            scores = score_of(at, a, b)
            inside = (mine[at] >= a) & (mine[at] < b)
            if packed:
                keys = (scores << RANK_BITS) | tie[a:b]
                keys[np.flatnonzero(inside), mine[at][inside] - a] = NOTHING
                both = np.concatenate((best[at], keys), 1)
                best[at] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            else:
                scores[np.flatnonzero(inside), mine[at][inside] - a] = NOTHING
                both = np.concatenate((best[at], scores), 1)
                beside = np.concatenate((ties[at], np.broadcast_to(tie[a:b], scores.shape)), 1)
                top = np.lexsort((beside, both), axis=1)[:, -k:]
                best[at], ties[at] = np.take_along_axis(both, top, 1), np.take_along_axis(beside, top, 1)
    who, col = np.nonzero(best != NOTHING)
    key = best[who, col]
    place = key & ((1 << RANK_BITS) - 1) if packed else ties[who, col]
    found = np.argsort(tree["rank"])[(1 << RANK_BITS) - 1 - place]
    value = key >> RANK_BITS if packed else key
    keep = value >= least[who]
    return np.stack([who[keep], found[keep]], 1), value[keep]


def _in_limbs(queries: np.ndarray, points: np.ndarray, at: np.ndarray, a: int, b: int) -> np.ndarray:
    """Products of whole numbers whose sums do not fit a double's mantissa: signed limbs, each product exact, sums modulo 2**64."""
    def limbs(x: np.ndarray) -> list[np.ndarray]:
        out = []
        while x.any():
            low = x & ((1 << LIMB) - 1)
            out.append(low.astype(np.float64))
            x = x >> LIMB
            if (x == -1).all() or len(out) == 3:  # what is left is a sign, or the last limb
                out.append(x.astype(np.float64))
                break
        return out

    total = np.zeros((len(at), b - a), np.int64)
    for i, x in enumerate(limbs(queries[at])):
        for j, y in enumerate(limbs(points[a:b])):
            if (i + j) * LIMB < 64:
                total += (x @ y.T).astype(np.int64) << np.int64((i + j) * LIMB)
    return total


def _trees(table: pa.Table, k: int, dims: int) -> pa.Table:
    ids = table.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
    tree = build_tree(ids, table.column("uid").to_numpy(), _matrix(table.column("v"), dims), k)
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "tree": pa.array([_pack(**tree)], pa.binary())})


def _blocks(table: pa.Table, dims: int) -> pa.Table:
    packed = _pack(ids=table.column("id").to_numpy(), uids=table.column("uid").to_numpy(), points=_narrow(_matrix(table.column("v"), dims)))
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "queries": pa.array([packed], pa.binary())})


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, queries, least, tree) to (block, least, hits)."""
    for batch in batches:
        for block, queries, least, tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            q, t = _unpack(queries), _unpack(tree)
            floor = np.frombuffer(least, np.int64) if least else np.full(len(q["uids"]), NOTHING)
            pairs, scores = search(t, q["points"], q["uids"], floor, k)
            who, found = pairs[:, 0], pairs[:, 1]
            kth = np.full(len(floor), NOTHING)
            if not least:
                count = np.bincount(who, minlength=len(floor))
                full = count >= k
                low = np.full(len(floor), np.iinfo(np.int64).max)
                np.minimum.at(low, who, scores)
                kth[full] = low[full]
            ids = t["ids"][found]
            hits = [q["uids"][who], q["ids"][who], ids, t["uids"][found], scores]
            lists = [pa.array([h.tolist()], pa.list_(pa.int64())) for h in hits]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([kth.tobytes()], pa.binary()), *lists], names=["block", "least", "quid", "query_id", "vec_id", "uid", "score"])


def top_k(rows: DataFrame, k: int, is_query: Column, id_col: str, vec_col: str, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for which ``is_query``
    (of a column ``id``) holds, by inner product of the components floor(scale * x)."""
    v = rows.select(rows[id_col].cast("long").alias("id"), rows[vec_col].cast("array<double>").alias("x"))
    v = v.where("x IS NOT NULL AND forall(x, y -> y IS NOT NULL AND NOT isnan(y) AND abs(y) < double('infinity'))")
    v = v.select("id", F.transform("x", lambda y: F.floor(y * scale).cast("long")).alias("v"))
    v = stored(v.withColumn("uid", F.monotonically_increasing_id()))
    n, asked, dims = v.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-n // SHARD), min(2 * cores, -(-n // LEAST_SHARD)), 1)
    blocks = max(-(-asked // BLOCK), min(2 * cores, -(-asked // LEAST_BLOCK)), 1)
    place = F.xxhash64("uid")

    def tree_of(table: pa.Table) -> pa.Table:
        return _trees(table, k, dims)

    def block_of(table: pa.Table) -> pa.Table:
        return _blocks(table, dims)

    trees = v.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(tree_of, "shard int, tree binary")
    trees = stored(trees)
    queries = v.where(is_query).withColumn("block", F.pmod(place, F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(block_of, "block int, queries binary")
    queries = stored(queries)
    found = "block int, least binary, quid array<long>, query_id array<long>, vec_id array<long>, uid array<long>, score array<long>"
    home = F.pmod(F.col("block"), F.lit(shards))
    first = queries.withColumn("shard", home).join(trees, "shard").select("block", "queries", F.lit(None).cast("binary").alias("least"), "tree")
    first = stored(first.repartition(blocks, "block").mapInArrow(partial(_searched, k=k), found))
    rest = queries.join(first.select("block", "least"), "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    rest = rest.join(trees, "shard").repartition(F.col("block"), F.col("shard")).select("block", "queries", "least", "tree")
    hits = first.unionByName(rest.mapInArrow(partial(_searched, k=k), found))
    hits = hits.select(F.explode(F.arrays_zip("quid", "query_id", "vec_id", "uid", "score")).alias("h")).select("h.*")
    rank = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    real = F.when(F.col("vec_id") < np.iinfo(np.int64).max, F.col("vec_id"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), real.alias("vec_id"), "score")


def op7_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20, F.col("id") % 20 == 0, "vec_id", "embedding")


OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, c.uid AS cuid, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST, cuid) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
