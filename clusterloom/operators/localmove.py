"""Local-move clustering (modularity, CPM, map equation).

Nodes move to the neighbouring cluster of the greatest gain until none gains.  Each cluster is then refined: its
nodes start alone again and merge, within the cluster only, with what they gain most by; the refined
groups become the nodes of the next level, which starts from the clusters before the refinement.  That is the
Leiden scheme with the best merge in place of a random one.  A run may be repeated from its result (``iterations``).
Clusters are split into connected pieces at the end in any case.
Connected components of at most ``IN_TASK_EDGES`` edges are solved in tasks, small ones many to a task; larger ones go through the same
phases by joins and aggregates, so that no task holds a component.  There many nodes move at once: a hashed half of
those that gain, fewer where the moves together do not raise the value, at last the best one alone, so the value rises
with every round and the rounds end by themselves.  The refinement merges nodes that are still alone into groups that wait
(a hashed half, anew in each round), drawn among the gaining ones by their gain.
Once a level has few enough edges the kernel of the small ones finishes it from the clusters found.  The graph's
total weight is passed in, and for the map equation the exit weight of all other components, in passes until
its value over the whole graph falls no more.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.bins import numbered as numbered_arrays
from clusterloom.operators.bins import numbered_ends, roots, streamed
from clusterloom.operators.components import connected_components
from clusterloom.operators.graph import dense_index
from clusterloom.operators.movearrays import move_arrays, visiting_order
from clusterloom.operators.refine import connected_clusters, connected_pieces, numbered, well_connected_clusters
from clusterloom.sources.edges import profile
from clusterloom.sources.storage import stored

MODELS = ("mod", "cpm", "infomap")
#: Edges that one task clusters at most.
IN_TASK_EDGES = 10_000_000
#: Edges of the components that share a bin, about.
MOVE_BIN_EDGES = 20_000
#: Neighbours of a node, on average, from which a level is moved over arrays instead of maps of neighbours.
MANY = 16
#: A round of joined moves that raises the value by less than this part of it brings a level near its end; two in a row end it.
PROGRESS = 1e-5
#: Scale of the refinement's draws, in gain for each unit of degree: the smaller, the more often the best merge is drawn.
RANDOMNESS = 0.01


def _plogp(x: float) -> float:
    return x * math.log2(x) if x > 0 else 0.0


def move_nodes(links: list[dict[int, float]], loops: list[float], sizes: list[int], model: str, gamma: float, m: float, seed: int, start: list[int] | None = None, bounds: list[int] | None = None, elsewhere: float = 0.0) -> list[int]:
    """One level: cluster of each node, by sweeps in a seeded order until no node moves.

    As in Leiden a sweep asks the nodes of which a neighbour moved to another cluster than theirs since they were asked.

    ``start``: clusters to begin with, else every node alone.  ``bounds``: one sweep in which nodes that are alone
    may join groups of the same bound, and no others (the refinement).  ``elsewhere``: exit weight outside this graph."""
    n = len(links)
    degree = [sum(a.values()) + 2 * loops[i] for i, a in enumerate(links)]
    label = list(start) if start else list(range(n))
    total, size, outside, members = ([0.0] * n for _ in range(4))
    for i, c in enumerate(label):
        total[c] += degree[i]
        size[c] += sizes[i]
        members[c] += 1
        outside[c] += sum(w for j, w in links[i].items() if label[j] != c)  # weight that leaves each cluster
    all_out = sum(outside) + elsewhere
    order = visiting_order(n, seed)
    asked = [True] * n  # a neighbour moved to another cluster since, or not asked yet

    def cost(c: int, out: float, vol: float) -> float:
        return -2 * _plogp(out / (2 * m)) + _plogp((out + vol) / (2 * m))

    while True:
        moved = False
        for i in [i for i in order if asked[i]]:
            own = label[i]
            asked[i] = False
            if bounds and members[own] > 1:
                continue
            near: dict[int, float] = {}
            for j, w in links[i].items():
                if not bounds or bounds[j] == bounds[i]:
                    near[label[j]] = near.get(label[j], 0.0) + w
            total[own] -= degree[i]
            size[own] -= sizes[i]
            reach = sum(links[i].values())
            if model == "infomap":
                out_own = outside[own] - reach + 2 * near.get(own, 0.0)
                base = all_out - outside[own] + out_own
                alone = cost(own, out_own, total[own])

            def gain(c: int) -> float:
                if model == "mod":
                    return near.get(c, 0.0) - gamma * degree[i] * total[c] / (2 * m)
                if model == "cpm":
                    return near.get(c, 0.0) - gamma * sizes[i] * size[c]
                out = (out_own if c == own else outside[c]) + reach - 2 * near.get(c, 0.0)
                old = alone if c == own else cost(c, outside[c], total[c])
                rest = out_own if c == own else outside[c]
                return -(_plogp((base - rest + out) / (2 * m)) + cost(c, out, total[c] + degree[i]) - old)

            best = max(sorted(near), key=gain, default=own)
            if gain(best) <= gain(own) + 1e-12:
                best = own
            if model == "infomap":
                left = outside[own]
                outside[own] = out_own
                new = outside[best] + reach - 2 * near.get(best, 0.0)
                all_out += out_own - left + new - outside[best]
                outside[best] = new
            total[best] += degree[i]
            size[best] += sizes[i]
            members[own] -= 1
            members[best] += 1
            label[i] = best
            if best != own:
                moved = True
                for j in links[i]:
                    if label[j] != best:
                        asked[j] = True
        if not moved or bounds:
            return label


def cluster_component(pairs: list[tuple[int, int, float]], n: int, model: str, gamma: float, m: float, seed: int, loops: list[float] | None = None, sizes: list[int] | None = None, iterations: int = 1, elsewhere: float = 0.0) -> list[int]:
    """Cluster of each of n nodes over weighted pairs, level by level; nodes may stand for groups.

    ``iterations`` runs, each from the clusters of the one before; below one, until a run changes nothing."""
    a, b, w = (np.array([x[k] for x in pairs], kind) for k, kind in enumerate((np.int64, np.int64, float)))
    first = (np.zeros(n) if loops is None else np.array(loops, float), np.ones(n, np.int64) if sizes is None else np.array(sizes))
    return cluster_arrays(a, b, w, *first, model, gamma, m, seed, iterations, elsewhere).tolist()


def cluster_arrays(a: np.ndarray, b: np.ndarray, w: np.ndarray, loops: np.ndarray, sizes: np.ndarray, model: str, gamma: float, m: float, seed: int, iterations: int = 1, elsewhere: float = 0.0, start: np.ndarray | None = None) -> np.ndarray:
    """``cluster_component`` over arrays of pairs, from the clusters ``start`` if given."""
    found, done = start, 0
    while True:
        label = _levels(a, b, w, loops, sizes, model, gamma, m, seed + done, found, elsewhere)
        done += 1
        if done == iterations or (found is not None and (label == found).all()):
            return label
        found = label


def _moved(a: np.ndarray, b: np.ndarray, w: np.ndarray, loops: np.ndarray, sizes: np.ndarray, *rest, **more) -> np.ndarray:
    """Clusters as 0, 1, ... after the moves of one level: over arrays where nodes have many neighbours, over maps where few."""
    if len(a) >= MANY * len(sizes) / 2:
        label = move_arrays(a, b, w, loops, sizes, *rest, **more)
    else:
        links: list[dict[int, float]] = [{} for _ in range(len(sizes))]
        for x, y, z in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            links[x][y] = links[x].get(y, 0.0) + z
            links[y][x] = links[y].get(x, 0.0) + z
        lists = {k: x.tolist() if isinstance(x, np.ndarray) else x for k, x in more.items()}
        label = move_nodes(links, loops.tolist(), sizes.tolist(), *rest, **lists)
    return np.unique(label, return_inverse=True)[1]


def _least(label: np.ndarray) -> np.ndarray:
    """For each node the least node of its cluster."""
    _, first, place = np.unique(label, return_index=True, return_inverse=True)
    return first[place]


def _levels(a: np.ndarray, b: np.ndarray, w: np.ndarray, loops: np.ndarray, sizes: np.ndarray, model: str, gamma: float, m: float, seed: int, start: np.ndarray | None, elsewhere: float) -> np.ndarray:
    member = np.arange(len(sizes))
    while True:
        level = (a, b, w, loops, sizes, model, gamma, m, seed)
        label = _moved(*level, start=start, elsewhere=elsewhere)
        group = _moved(*level, bounds=label, elsewhere=elsewhere)
        count = int(group.max(initial=-1)) + 1
        if count == len(sizes):
            return label[member]
        member = group[member]
        start = np.zeros(count, np.int64)
        start[group] = label
        x, y = group[a], group[b]
        apart = x != y
        loops = np.bincount(group, loops, count) + np.bincount(x[~apart], w[~apart], count)
        sizes = np.bincount(group, sizes, count).astype(np.int64)
        pairs, place = np.unique(np.minimum(x, y)[apart] * count + np.maximum(x, y)[apart], return_inverse=True)
        a, b, w = pairs // count, pairs % count, np.bincount(place, w[apart], len(pairs))


def _column_plogp(x: Column) -> Column:
    return F.when(x > 1e-15, x * F.log2(x)).otherwise(0.0)


def _value(totals: DataFrame, model: str, gamma: float, m: float) -> float:
    """What the moves increase, from the sums of each cluster."""
    k, size, inner = F.col("k"), F.col("size"), F.col("inner")
    if model == "mod":
        found = F.sum(inner / m - gamma * F.pow(k / (2 * m), 2.0))
    elif model == "cpm":
        found = F.sum(inner - gamma * size * size / 2)
    else:
        q, p = (k - 2 * inner) / (2 * m), k / (2 * m)
        found = 2 * F.sum(_column_plogp(q)) - F.sum(_column_plogp(q + p)) - _column_plogp(F.sum(q))
    return totals.agg(F.coalesce(found, F.lit(0.0))).first()[0]


def _gain(model: str, gamma: float, m: float, all_out: float) -> Column:
    """Gain of leaving one's cluster (``_own``) for a neighbouring one, both with the node counted where it is."""
    w, w_own, deg, size = F.col("w"), F.col("w_own"), F.col("deg"), F.col("n")
    if model == "mod":
        return w - w_own - gamma * deg * (F.col("k") - F.col("k_own") + deg) / (2 * m)
    if model == "cpm":
        return w - w_own - gamma * size * (F.col("size") - F.col("size_own") + size)
    reach = deg - 2 * F.col("loop")
    out, out_own = F.col("k") - 2 * F.col("inner"), F.col("k_own") - 2 * F.col("inner_own")
    to, left = out + reach - 2 * w, out_own - reach + 2 * w_own
    h = lambda x: _column_plogp(x / (2 * m))
    index = h(F.lit(all_out) - out - out_own + to + left) - h(F.lit(all_out))
    exits = h(to) + h(left) - h(out) - h(out_own)
    modules = h(to + F.col("k") + deg) + h(left + F.col("k_own") - deg) - h(out + F.col("k")) - h(out_own + F.col("k_own"))
    return -(index - 2 * exits + modules)


def _near(links: DataFrame, state: DataFrame, group: str) -> DataFrame:
    """(u, group, w): weight from each node to each group of its neighbours, itself left out."""
    return links.join(state.selectExpr("node AS v", group), "v").groupBy("u", group).agg(F.expr("sum(w) AS w"))


def _sums(near: DataFrame, state: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """``state`` with ``own`` and the weight ``w_own`` to it, and (group, k, size, inner) of the groups."""
    mine = state.join(near.withColumnRenamed("u", "node"), ["node", group], "left").withColumnRenamed(group, "own").withColumn("w_own", F.expr("coalesce(w, 0D)")).drop("w")
    return mine, mine.groupBy(F.col("own").alias(group)).agg(F.expr("sum(deg) AS k"), F.expr("sum(n) AS size"), F.expr("sum(loop) + sum(w_own) / 2 AS inner"))


def _offers(near: DataFrame, mine: DataFrame, totals: DataFrame, group: str, model: str, gamma: float, m: float, all_out: float) -> DataFrame:
    """Rows of ``mine`` for each neighbouring group that they gain by joining: ``group`` and ``gain``."""
    own = totals.selectExpr(f"{group} AS own", "k AS k_own", "size AS size_own", "inner AS inner_own")
    asked = near.withColumnRenamed("u", "node").join(mine.join(own, "own"), "node").where(f"{group} <> own").join(totals, group)
    return asked.withColumn("gain", _gain(model, gamma, m, all_out)).where("gain > 1e-12")


def _all_out(totals: DataFrame) -> float:
    return totals.agg(F.expr("coalesce(sum(k - 2 * inner), 0D)")).first()[0]


def _level(links: DataFrame, state: DataFrame, model: str, gamma: float, m: float, seed: int) -> DataFrame:
    """The labels ``comm`` of ``state`` (node, comm, deg, n, loop, component) once no round of moves raises the value further."""

    def known(state: DataFrame) -> tuple:
        near = stored(_near(links, state, "comm"))
        mine, totals = _sums(near, state, "comm")
        return state, near, mine, totals, _value(totals, model, gamma, m)

    now, round_, slow = known(state), 0, 0
    while slow < 2:
        state, near, mine, totals, value = now
        gains = _offers(near, mine, totals, "comm", model, gamma, m, _all_out(totals) if model == "infomap" else 0.0)
        to = gains.groupBy("node").agg(F.expr("max(struct(gain, -comm AS less)) AS b")).selectExpr("node", "-b.less AS new", "b.gain")
        to = stored(to)
        turn = f"pmod(xxhash64({seed}, {round_}, node), 1048576) / 1048576D"
        one = to.orderBy(F.desc("gain"), "node").limit(1)
        better = None
        for some in (*(to.where(f"{turn} < {part}") for part in (0.5, 0.125, 0.03125)), one):
            moved = state.join(some.select("node", "new"), "node", "left").withColumn("comm", F.expr("coalesce(new, comm)")).drop("new")
            found = known(stored(moved.select(*state.columns)))
            if found[-1] > value + 1e-12:
                better = found
                break
        if better is None:
            break
        slow = slow + 1 if better[-1] - value < PROGRESS * abs(value) else 0
        now, round_ = better, round_ + 1
    return now[0]


def _refined(links: DataFrame, state: DataFrame, model: str, gamma: float, m: float, seed: int) -> DataFrame:
    """``state`` with ``grp``: connected groups within the clusters ``comm``, from every node alone.

    A node that is alone, and well connected to its cluster, joins a waiting group of it by which it gains; which one is
    drawn with weights exp(gain / scale).  Each group is as well connected to its cluster when it is joined."""
    inside = stored(links.join(state.selectExpr("node AS u", "comm AS a"), "u").join(state.selectExpr("node AS v", "comm AS b"), "v").where("a = b").select("u", "v", "w"))
    reach = inside.groupBy(F.col("u").alias("node")).agg(F.expr("sum(w) AS reach"))
    clusters = state.groupBy("comm").agg(F.expr("sum(deg) AS k_comm"), F.expr("sum(n) AS n_comm"))
    rows = stored(state.join(reach, "node", "left").join(clusters, "comm").withColumn("reach", F.expr("coalesce(reach, 0D)")).withColumn("grp", F.col("node")))
    keep = [c for c in rows.columns if c != "grp"]
    least = {"mod": f"{gamma!r}D * k * (k_comm - k) / {2 * m!r}D", "cpm": f"{gamma!r}D * size * (n_comm - size)"}.get(model)
    round_ = 0
    while True:
        near = stored(_near(inside, rows, "grp"))
        mine, totals = _sums(near, rows, "grp")
        facts = mine.groupBy(F.col("own").alias("grp")).agg(F.expr("sum(reach - w_own) AS leaves"), F.expr("count(1) AS members"), F.expr("first(k_comm) AS k_comm"), F.expr("first(n_comm) AS n_comm"))
        facts = totals.join(facts, "grp").withColumn("fit", F.expr(f"leaves >= {least}") if least else F.lit(True))
        fit = facts.where("fit")
        alone = mine.join(fit.where("members = 1").selectExpr("grp AS own"), "own", "left_semi").select("node", "own", "w_own", "deg", "n", "loop")
        all_out = _all_out(totals) if model == "infomap" else 0.0
        gains = stored(_offers(near, alone, totals, "grp", model, gamma, m, all_out).join(fit.select("grp"), "grp", "left_semi").select("node", "own", "grp", "deg", "gain"))
        if gains.isEmpty():
            return rows.select(*state.columns, "grp")
        waits = lambda c: f"pmod(xxhash64({seed}, {round_}, {c}), 2) = 0"
        noise = f"-ln(-ln((pmod(xxhash64({seed + 1}, {round_}, node, grp), 1048576) + 0.5D) / 1048576D))"
        scale = f"{RANDOMNESS}D * deg" if model == "mod" else f"{RANDOMNESS}D" if model == "cpm" else f"{RANDOMNESS / m!r}D"
        drawn = gains.where(f"NOT ({waits('own')}) AND {waits('grp')}").groupBy("node").agg(F.expr(f"max(struct(gain / ({scale}) + {noise} AS x, grp)) AS b"))
        rows = stored(rows.join(drawn.selectExpr("node", "b.grp AS to"), "node", "left").selectExpr(*keep, "coalesce(to, grp) AS grp"))
        round_ += 1


def _aggregated(links: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups ``grp`` as nodes: links between them, and their state in the clusters that hold them."""
    ends = links.join(state.selectExpr("node AS u", "grp AS a"), "u").join(state.selectExpr("node AS v", "grp AS b"), "v")
    inner = ends.where("a = b").groupBy(F.col("a").alias("grp")).agg(F.expr("sum(w) / 2 AS inner"))
    names = state.groupBy("comm").agg(F.expr("min(grp) AS name"))
    merged = state.join(names, "comm").groupBy("grp").agg(F.expr("first(name) AS comm"), F.expr("sum(deg) AS deg"), F.expr("sum(n) AS n"), F.expr("sum(loop) AS loop"), F.expr("first(component) AS component"))
    merged = merged.join(inner, "grp", "left").selectExpr("grp AS node", "comm", "deg", "n", "loop + coalesce(inner, 0D) AS loop", "component")
    return stored(ends.where("a <> b").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.expr("sum(w) AS w"))), stored(merged)


def _distributed(grouped: DataFrame, model: str, gamma: float, m: float, seed: int, iterations: int = 1) -> DataFrame:
    """(node_id, piece) of the nodes of (src, dst, weight, component), each pair once, without one task holding them."""
    ends = grouped.select(F.col("src").alias("node_id"), "component").union(grouped.select("dst", "component")).distinct()
    ids = stored(dense_index(ends, ["node_id"], "id").selectExpr("node_id", "CAST(id AS BIGINT) AS id", "component"))
    one = grouped.join(ids.selectExpr("node_id AS src", "id AS u"), "src").join(ids.selectExpr("node_id AS dst", "id AS v"), "dst").selectExpr("u", "v", "weight AS w")
    links = stored(one.union(one.select("v", "u", "w")))
    degree = links.groupBy(F.col("u").alias("id")).agg(F.expr("sum(w) AS deg"))
    alone = ids.join(degree, "id").selectExpr("id AS node", "id AS comm", "deg", "1L AS n", "0D AS loop", "component")
    state, done, before = stored(alone), 0, None
    while True:
        label = _hierarchy(links, state, model, gamma, m, seed + done)
        done += 1
        changed = before is None or not before.join(label, ["node", "comm"], "left_anti").isEmpty()
        if done == iterations or not changed:
            break
        before = label
        state = stored(alone.drop("comm").join(label, "node").select(*alone.columns))
    least = ids.withColumnRenamed("id", "node").join(label, "node")
    named = least.groupBy("comm").agg(F.min("node_id").alias("piece"))
    return least.join(named, "comm").select("node_id", "piece")


def _hierarchy(links: DataFrame, state: DataFrame, model: str, gamma: float, m: float, seed: int) -> DataFrame:
    """(node, comm): levels of moves, refinement and aggregation; a cluster is named by its smallest node."""
    member = state.selectExpr("node", "node AS at")
    while True:
        if links.count() <= 2 * IN_TASK_EDGES:
            state = _rest(links, state, model, gamma, m, seed)
            break
        state = _level(links, state, model, gamma, m, seed)
        refined = stored(_refined(links, state, model, gamma, m, seed))
        if refined.where("grp <> node").isEmpty():
            break
        member = stored(member.join(refined.selectExpr("node AS at", "grp"), "at").selectExpr("node", "grp AS at"))
        links, state = _aggregated(links, refined)
    found = stored(member.join(state.selectExpr("node AS at", "comm"), "at").select("node", "comm"))
    names = found.groupBy("comm").agg(F.expr("min(node) AS name"))
    return stored(found.join(names, "comm").selectExpr("node", "name AS comm"))


def _rest(links: DataFrame, state: DataFrame, model: str, gamma: float, m: float, seed: int) -> DataFrame:
    """(node, comm) of a level of at most 2 x IN_TASK_EDGES rows, from its clusters; nodes that no edge names keep their own."""
    of = lambda end: state.selectExpr(f"node AS {end}", f"n AS n{end}", f"loop AS l{end}", f"comm AS c{end}", *(["component"] if end == "u" else []))
    rows = links.where("u < v").join(of("u"), "u").join(of("v"), "v")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, a, b = numbered_ends(pdf.rename(columns={"u": "src", "v": "dst"}))
        sizes, loops, start = np.ones(len(names), np.int64), np.zeros(len(names)), np.zeros(len(names), np.int64)
        for end, at in zip("uv", (a, b), strict=True):
            sizes[at], loops[at], start[at] = pdf[f"n{end}"], pdf[f"l{end}"], pdf[f"c{end}"]
        start = np.unique(start, return_inverse=True)[1]
        label = _levels(a, b, pdf["w"].to_numpy(), loops, sizes, model, gamma, m, seed, start, 0.0)
        return pd.DataFrame({"node": names, "comm": names[_least(label)]})

    found = rows.groupBy("component").applyInPandas(solve, "node long, comm long")
    return stored(state.select("node").join(found, "node", "left").selectExpr("node", "coalesce(comm, node) AS comm"))


def prepared(edges: DataFrame) -> tuple[DataFrame, float]:
    """The accumulated loopless edges with their component and its number of edges, and the total weight."""
    links = stored(profile(edges.where("src IS NOT NULL AND dst IS NOT NULL"), "accumulated").where("src <> dst"))
    m = float(links.agg(F.coalesce(F.sum("weight"), F.lit(1.0))).first()[0])
    grouped = stored(links.join(connected_components(links).select(F.col("node").alias("src"), "component"), "src"))
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    return stored(grouped.join(sizes, "component")), m


def _exits(grouped: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, cluster, out, vol): weight that leaves each cluster, and the degrees in it."""
    a = labels.select(F.col("node_id").alias("src"), F.col("piece").alias("a"))
    b = labels.select(F.col("node_id").alias("dst"), F.col("piece").alias("b"))
    ends = grouped.join(a, "src").join(b, "dst")
    both = ends.select("component", F.col("a").alias("c"), "weight", (F.col("a") != F.col("b")).alias("apart"))
    both = both.unionByName(ends.select("component", F.col("b").alias("c"), "weight", (F.col("a") != F.col("b")).alias("apart")))
    return both.groupBy("component", "c").agg(F.sum(F.when(F.col("apart"), F.col("weight")).otherwise(0.0)).alias("out"), F.sum("weight").alias("vol"))


def _binned(grouped: DataFrame) -> tuple[DataFrame, int]:
    """Of ``prepared`` edges those of components that one task clusters, with ``bin``, and the number of partitions to deal them to.

    A component is whole in its bin; small ones share bins."""
    small = grouped.where(F.col("n_edges") <= IN_TASK_EDGES)
    few = F.col("n_edges") <= MOVE_BIN_EDGES / 2
    sums = small.agg(F.coalesce(F.sum(F.when(few, 1)), F.lit(0)), F.coalesce(F.sum(F.when(~few, 1 / F.col("n_edges"))), F.lit(0.0))).first()
    bins = math.ceil(sums[0] / MOVE_BIN_EDGES) or 1
    alone = F.xxhash64("component", F.lit(1))  # no other component falls there but by a chance of 2^-64
    return small.withColumn("bin", F.when(few, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(alone)), 4 * (bins + round(sums[1]))


def local_labels(ready: tuple[DataFrame, float], model: str, resolution: float = 1.0, seed: int = 1234, iterations: int = 1, split: bool = False) -> DataFrame:
    """(node_id, piece) of the nodes of ``prepared`` edges; a piece is named by its smallest node.

    ``split``: clusters that a task finds are parted into what their inner edges connect."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; one of {MODELS}")
    grouped, m = ready
    node = grouped.schema["src"].dataType.simpleString()

    def solve(src: np.ndarray, dst: np.ndarray, w: np.ndarray, elsewhere: float) -> list[np.ndarray]:
        names, a, b = numbered_arrays(src, dst)
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        n = len(names)
        label = cluster_arrays(a, b, w, np.zeros(n), np.ones(n, np.int64), model, resolution, m, seed, iterations, elsewhere)
        if split:
            inner = label[a] == label[b]
            label = roots(a[inner], b[inner], n)
        return [names, names[_least(label)]]

    large = grouped.where(F.col("n_edges") > IN_TASK_EDGES).select("src", "dst", "weight", "component")
    far = None
    if not large.isEmpty():
        far = stored(_distributed(large, model, resolution, m, seed, iterations))
        if split:
            far = connected_pieces(large, far.withColumnRenamed("piece", "cluster_id"))
    binned, parts = _binned(grouped)

    def solved(rows: DataFrame) -> DataFrame:
        dealt = rows.select("src", "dst", "weight", "component", "elsewhere", "bin").repartition(parts, "bin")
        found = streamed(dealt, "component", ["src", "dst", "weight"], ["elsewhere"], solve, f"node_id {node}, piece {node}")
        return found if far is None else found.unionByName(far)

    found = solved(binned.withColumn("elsewhere", F.lit(0.0)))
    if model != "infomap":
        return found
    best, value = None, math.inf
    while True:  # the index term needs what leaves the clusters of all other components
        found = stored(found)
        exits = stored(_exits(grouped, found))
        h = lambda x: _column_plogp(x / (2 * m))
        out, rest = exits.agg(F.coalesce(F.sum("out"), F.lit(0.0)), F.coalesce(F.sum(h(F.col("out") + F.col("vol")) - 2 * h(F.col("out"))), F.lit(0.0))).first()
        new = _plogp(out / (2 * m)) + rest
        if new > value - 1e-9:
            return best
        best, value = found, new
        if not out:  # nothing leaves a cluster anywhere, so another pass would be the same
            return best
        own = exits.groupBy("component").agg((F.lit(out) - F.sum("out")).alias("elsewhere"))
        found = solved(binned.join(own, "component"))


def _index_length(exits: DataFrame, m: float) -> float:
    """Rates of modules and of what is in them (``_exits``) to the map equation, without the part of single nodes."""
    h = lambda x: f"CASE WHEN {x} > 0 THEN ({x}) / {2 * m!r}D * log2(({x}) / {2 * m!r}D) ELSE 0D END"
    out, rest = exits.agg(F.expr("coalesce(sum(out), 0D)"), F.expr(f"coalesce(sum({h('out + vol')} - 2 * ({h('out')})), 0D)")).first()
    return _plogp(out / (2 * m)) + rest


def map_levels(edges: DataFrame, seed: int = 1234) -> tuple[list[DataFrame], float]:
    """Modules (node_id, piece) level by level, the innermost first, and the code length in bits of the whole hierarchy.

    Modules are grouped as nodes were: an index codebook for each group of modules takes the place of one for all while that
    is shorter.  The rates at which a walk leaves modules are to the groups what visits of nodes are to modules, so the
    same moves minimise them, over the weights between modules and with the weight of the whole graph.
    An empty graph has one empty level and length 0."""
    grouped, m = ready = prepared(edges)
    labels = stored(local_labels(ready, "infomap", seed=seed))
    exits = stored(_exits(grouped, labels))
    h = lambda x: F.expr(f"coalesce(sum({x} / {2 * m!r}D * log2({x} / {2 * m!r}D)), 0D)")
    visits = grouped.select(F.col("src").alias("v"), "weight").union(grouped.select("dst", "weight")).groupBy("v").agg(F.expr("sum(weight) AS k")).agg(h("k")).first()[0]
    levels, length, links = [labels], _index_length(exits, m) - visits, grouped
    while True:
        a, b = labels.selectExpr("node_id AS src", "piece AS a"), labels.selectExpr("node_id AS dst", "piece AS b")
        across = links.join(a, "src").join(b, "dst").where("a <> b").groupBy(F.expr("least(a, b) AS src"), F.expr("greatest(a, b) AS dst")).agg(F.expr("sum(weight) AS weight"))
        above, _ = prepared(across)
        if above.isEmpty():
            return levels, length
        labels = stored(local_labels((above, m), "infomap", seed=seed))
        one_book = _plogp(exits.agg(F.expr("sum(out)")).first()[0] / (2 * m))
        exits = stored(_exits(above, labels))
        books = _index_length(exits, m)
        if books >= one_book - 1e-9:
            return levels, length
        length += books - one_book
        down = levels[-1].join(labels.selectExpr("node_id AS piece", "piece AS top"), "piece", "left")
        levels.append(stored(down.selectExpr("node_id", "coalesce(top, piece) AS piece")))
        links = above


def local_move(edges: DataFrame, model: str, resolution: float = 1.0, seed: int = 1234, iterations: int = 2) -> DataFrame:
    """(node_id, cluster_id) by the model ``mod``, ``cpm`` or ``infomap`` (its outermost modules); connected, no singletons.

    Weights of the edges count; ``iterations`` as in ``cluster_component``.
    Rows with a null end are ignored; an empty graph gives no rows."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; one of {MODELS}")
    if model == "infomap":
        return connected_clusters(edges, numbered(map_levels(edges, seed)[0][-1]))
    return numbered(local_labels(prepared(edges), model, resolution, seed, iterations, split=True))


def modified_clusters(edges: DataFrame, clustering: DataFrame, criterion: str, model: str = "mod", resolution: float = 1.0, seed: int = 1234) -> DataFrame:
    """CM: clusters cut at minimum cuts, each side clustered anew by ``mod`` or ``cpm``, until all pieces
    are well connected; no singletons."""
    if model not in ("mod", "cpm"):
        raise ValueError(f"no connectivity modifier for {model!r}")

    def again(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        label = cluster_arrays(a, b, np.ones(len(a)), np.zeros(n), np.ones(n, np.int64), model, resolution, float(len(a)) or 1.0, seed)
        return np.unique(label, return_inverse=True)[1]

    def regroup(links: DataFrame) -> DataFrame:
        """The sides (cluster_id) of cuts of clusters that no task holds, each clustered by itself with its own weight."""
        node = edges.schema["src"].dataType.simpleString()
        sizes = stored(links.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m")))
        small = links.join(sizes.where(F.col("m") <= IN_TASK_EDGES), "cluster_id", "left_semi")

        def solve(src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
            names, a, b = numbered_arrays(src, dst)
            order = np.lexsort((b, a))
            return [names, names[_least(again(a[order], b[order], len(names)))]]

        found = streamed(small.repartition("cluster_id"), "cluster_id", ["src", "dst"], [], solve, f"node_id {node}, cluster_id {node}")
        for row in sizes.where(F.col("m") > IN_TASK_EDGES).collect():  # so few that all of them have no more edges than the graph
            side = links.where(F.col("cluster_id") == F.lit(row["cluster_id"])).selectExpr("src", "dst", "1D AS weight", "cluster_id AS component")
            found = found.unionByName(_distributed(side, model, resolution, float(row["m"]), seed).withColumnRenamed("piece", "cluster_id"))
        return stored(found)

    return well_connected_clusters(edges, clustering, criterion, again, regroup)
