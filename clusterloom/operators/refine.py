"""Refinements of a clustering: connected pieces (CC) and well-connected pieces (WCC, CM)."""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.bins import neighbours, roots, streamed
from clusterloom.operators.bins import numbered as numbered_arrays
from clusterloom.operators.components import connected_components
from clusterloom.operators.graph import dense_index
from clusterloom.operators.mincuts import Links, most_even
from clusterloom.sources.edges import profile
from clusterloom.sources.storage import stored

#: Edges of a cluster that one task holds, unless a sparse certificate is larger.
IN_TASK_EDGES = 10_000_000
#: Edges of a part above which what a cut leaves of it is dealt to tasks anew.
ONCE_EDGES = 400_000
#: Partitions for each so many edges of the clusters that tasks cut, so that large clusters meet in a task by rare chance only.
EDGES_IN_PART = 250_000
#: Edges of the small clusters that a task cuts in one call, about.
CUT_BIN_EDGES = 20_000

_CRITERION = re.compile(r"^\s*([0-9.eE+-]+)?\s*(?:n\^([0-9.]+)|log_([0-9.]+)\(n\))?\s*$")


def criterion_text(name: str | None) -> tuple[str, str]:
    """The (WCC, CM) expressions behind a criterion name."""
    if not name:
        return "1log_10(n)", "0.2n^0.5"
    return {"sqrt": ("0.2n^0.5",) * 2, "log": ("1log_10(n)",) * 2}.get(name, (name, name))


def parse_criterion(text: str) -> tuple[float, str, float]:
    """(factor, kind, parameter) of ``c``, ``c n^p`` or ``c log_b(n)``."""
    m = _CRITERION.match(text)
    if not m or not text.strip():
        raise ValueError(f"not a criterion: {text!r}")
    c, p, b = m.groups()
    factor = float(c) if c else 1.0
    return (factor, "power", float(p)) if p else (factor, "log", float(b)) if b else (factor, "constant", 0.0)


def criterion_column(text: str, n: Column) -> Column:
    c, kind, x = parse_criterion(text)
    return F.lit(c) * (F.pow(n, F.lit(x)) if kind == "power" else F.log(x, n) if kind == "log" else F.lit(1.0))


def bound(text: str, n: int) -> float:
    c, kind, x = parse_criterion(text)
    return c * (n**x if kind == "power" else math.log(n, x) if kind == "log" else 1.0)


def inside(edges: DataFrame, clustering: DataFrame) -> DataFrame:
    """(cluster_id, src, dst) of the simple edges within clusters."""
    simple = profile(edges, "simple").select("src", "dst")
    a = clustering.select(F.col("node_id").alias("src"), F.col("cluster_id").alias("ca"))
    b = clustering.select(F.col("node_id").alias("dst"), F.col("cluster_id").alias("cb"))
    return simple.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("ca").alias("cluster_id"), "src", "dst")


def connected_clusters(edges: DataFrame, clustering: DataFrame) -> DataFrame:
    """CC: every cluster split into its connected components; singletons go; ids by smallest node."""
    return numbered(connected_pieces(edges, clustering))


def connected_pieces(edges: DataFrame, clustering: DataFrame) -> DataFrame:
    """(node_id, piece): what the edges within clusters connect, named by its smallest node; nodes without such an edge are left out."""
    parts = connected_components(inside(edges, clustering).select("src", "dst"))
    return parts.select(F.col("node").alias("node_id"), F.col("component").alias("piece"))


def numbered(pieces: DataFrame) -> DataFrame:
    """(node_id, piece) to dense cluster ids in the order of the pieces, without singletons.

    The pieces are written once: sizes, ranks and labels all read them, and a kernel stands behind them."""
    pieces = stored(pieces)
    ids = dense_index(pieces.groupBy("piece").count().where("count > 1").select("piece"), ["piece"], "cluster_id")
    return pieces.join(ids, "piece").select("node_id", F.col("cluster_id").cast("long").alias("cluster_id"))


def min_cut(links: Links) -> tuple[float, list[int]]:
    """Weight and one side of a minimum cut of a connected graph of neighbour maps; a single node has no cut."""
    ends = [(i, v, x) for i, near in enumerate(links) for v, x in near.items() if i < v]
    a, b, w = (np.array([e[k] for e in ends], kind) for k, kind in enumerate((np.int64, np.int64, float)))
    return edges_cut(a, b, w, len(links))


def edges_cut(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[float, list[int]]:
    """Weight and one side of a minimum cut of n nodes that weighted edges, each pair once, connect.

    Each phase scans the nodes in maximum-adjacency order.  What an unscanned node has collected when an edge reaches
    it bounds the cuts between that edge's ends from below; edges whose bound is no less than the best cut known
    can't be in a better one and are contracted, all at once.  Cuts known are the least node and every prefix of the
    scan.  A phase takes edges x log nodes, and few are needed where most edges are contracted.  Edges are held in arrays
    only, some 240 bytes each at most."""
    group = np.arange(n)  # of every node at first
    best, side = math.inf, np.zeros(n, bool)
    while n > 1:
        degree = np.bincount(a, w, n) + np.bincount(b, w, n)
        least = int(degree.argmin())
        if degree[least] < best:
            best, side = float(degree[least]), group == least
        bound_of, order, cuts = _scanned(a, b, w, n, degree)
        at = int(cuts[:-1].argmin())
        if cuts[at] < best - 1e-12:
            best, side = float(cuts[at]), np.isin(group, order[: at + 1])
        smaller = _merged(a, b, w, n, bound_of >= best - 1e-12)
        if smaller is None:  # no edge at all: the parts are apart
            break
        a, b, w, n, place = smaller
        group = place[group]
    return best, np.flatnonzero(side).tolist()


def _scanned(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bound of each edge, order of the nodes, cut of each prefix) of a maximum-adjacency scan."""
    first, near, edge = neighbours(a, b, n)
    unit = bool((w == 1.0).all())
    weight = None if unit else w[edge]
    key, done, bound_of = np.zeros(n), np.zeros(n, bool), np.zeros(len(a), np.float32 if unit else float)
    order, cuts, cut, rest = np.zeros(n, np.int64), np.zeros(n), 0.0, 0
    heap = [(0.0, 0)]
    for place in range(n):
        while heap and (done[heap[0][1]] or -heap[0][0] != key[heap[0][1]]):
            heapq.heappop(heap)
        if heap:
            i = heapq.heappop(heap)[1]
        else:
            while done[rest]:
                rest += 1
            i = rest
        done[i] = True
        cut += degree[i] - 2 * key[i]
        order[place], cuts[place] = i, cut
        here = slice(first[i], first[i + 1])
        fresh = ~done[near[here]]
        to = near[here][fresh]
        key[to] += 1.0 if unit else weight[here][fresh]
        bound_of[edge[here][fresh]] = key[to]
        for entry in zip((-key[to]).tolist(), to.tolist(), strict=True):
            heapq.heappush(heap, entry)
    return bound_of, order, cuts


def _merged(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, close: np.ndarray) -> tuple | None:
    """The graph (a, b, w, n) with the ends of ``close`` edges merged, and each node's place there; None if nothing merges."""
    _, place = np.unique(roots(a[close], b[close], n), return_inverse=True)
    smaller = int(place.max()) + 1
    if smaller == n:
        return None
    x, y = place[a], place[b]
    apart = x != y
    pairs, where = np.unique(np.minimum(x, y)[apart] * smaller + np.maximum(x, y)[apart], return_inverse=True)
    return pairs // smaller, pairs % smaller, np.bincount(where, w[apart], len(pairs)), smaller, place


def even_cut(a: np.ndarray, b: np.ndarray, n: int, value: float) -> np.ndarray:
    """Whether each of n nodes is on the side without node 0 of the most even of all minimum cuts, whose weight is ``value``.

    Of several as even that side's least nodes decide.  What no such cut parts is merged first, over arrays."""
    w, group = np.ones(len(a)), np.arange(n)
    while True:
        count = int(group.max()) + 1
        degree = np.bincount(a, w, count) + np.bincount(b, w, count)
        smaller = _merged(a, b, w, count, _scanned(a, b, w, count, degree)[0] > value + 1e-9)
        if smaller is None:
            break
        a, b, w, _, place = smaller
        group = place[group]
    links: Links = [{} for _ in range(count)]
    for x, y, z in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        links[x][y] = links[y][x] = links[x].get(y, 0.0) + z
    order = np.argsort(group, kind="stable")
    members = np.split(order, np.cumsum(np.bincount(group, minlength=count))[:-1])
    return np.isin(group, most_even(links, members, value))


def _by_label(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The subgraphs (nodes, a, b) of the nodes of each label, with ends as places in their nodes."""
    order = np.argsort(label, kind="stable")
    counts = np.bincount(label)
    first = np.cumsum(counts) - counts
    place = np.empty(len(label), np.int32)
    place[order] = np.arange(len(label)) - np.repeat(first, counts)
    inner = label[a] == label[b]
    a, b = a[inner], b[inner]
    of = label[a]
    by = np.argsort(of, kind="stable")
    a, b, ends = place[a][by], place[b][by], np.cumsum(np.bincount(of, minlength=len(counts)))
    return [(nodes[order[first[g] : first[g] + counts[g]]], a[(lo := ends[g - 1] if g else 0) : ends[g]], b[lo : ends[g]]) for g in range(len(counts)) if counts[g]]


def pieces_of(a: np.ndarray, b: np.ndarray, n: int, criterion: str, recluster=None, balanced: bool = False, once: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pieces of n nodes whose minimum cut exceeds the criterion; ``recluster`` (a, b, n) groups each side of a cut first.

    A part is first split into components, then cut at any of its minimum cuts, or at the most even of them if ``balanced``.  What parts of more than
    ``once`` edges fall to is not judged here but returned second; judged by itself it ends in the same pieces."""
    todo, done, later = [(np.arange(n), a, b)], [], []
    while todo:
        nodes, a, b = todo.pop()
        n = len(nodes)
        if n < 2:
            continue
        apart = np.unique(roots(a, b, n), return_inverse=True)[1]
        if apart.any():
            todo += _by_label(nodes, a, b, apart)
            continue
        cut, side = edges_cut(a, b, np.ones(len(a)), n)
        if cut > bound(criterion, n):
            done.append(nodes)
            continue
        if balanced and n > 3:
            label = even_cut(a, b, n, cut).astype(np.int64)
        else:
            label = np.zeros(n, np.int64)
            label[side] = 1
        fallen = []
        for half in _by_label(nodes, a, b, label):
            fallen += _by_label(*half, recluster(half[1], half[2], len(half[0]))) if recluster and len(half[0]) > 1 else [half]
        if once is not None and len(a) > once:
            later += [x[0] for x in fallen if len(x[0]) > 1]
        else:
            todo += fallen
    return done, later


def well_connected(links: Links, criterion: str, balanced: bool = False) -> list[list[int]]:
    """``pieces_of`` a graph of neighbour maps, whose weights do not count."""
    ends = [(i, v) for i, near in enumerate(links) for v in near if i < v]
    a, b = np.array(ends, np.int64).reshape(-1, 2).T
    return [p.tolist() for p in pieces_of(a, b, len(links), criterion, balanced=balanced)[0]]


def forest_levels(src: list[int], dst: list[int], n: int, k: int) -> tuple[list[int], list[int]]:
    """For each edge the first of k forests that it joins two trees of, k if there is none, and each node's tree in the last.

    Each forest spans what the ones before leave over.  So a cut of fewer than k edges has all of them in the forests, a
    larger one at least k, and nodes in one tree of the last forest are on the same side of every cut of fewer than k edges."""
    tree = [list(range(n)) for _ in range(k)]

    def find(up: list[int], i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    level = []
    for a, b in zip(src, dst, strict=True):
        low, high = 0, k  # joined in a forest means joined in all before it
        while low < high:
            middle = (low + high) // 2
            if find(tree[middle], a) == find(tree[middle], b):
                low = middle + 1
            else:
                high = middle
        level.append(low)
        if low < k:
            tree[low][find(tree[low], a)] = find(tree[low], b)
    return level, [find(tree[-1], i) for i in range(n)]


def _places(pdf: pd.DataFrame) -> tuple[list, list[int], list[int]]:
    names = sorted(set(pdf["src"]) | set(pdf["dst"]))
    at = {v: i for i, v in enumerate(names)}
    return names, [at[v] for v in pdf["src"]], [at[v] for v in pdf["dst"]]


def sparse_certificate(links: DataFrame) -> DataFrame:
    """Of (cluster_id, src, dst, k): edges that keep every cut of a cluster of fewer than k edges, and k of the larger ones.

    Edges are dealt to chunks that one task holds, each is thinned to k forests, and what is left is dealt again while it
    shrinks: certificates of parts make one of the whole.  A cluster of n nodes ends with about k n edges."""
    columns = links.columns

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        names, src, dst = _places(pdf)
        k = int(pdf["k"].iloc[0])
        level, _ = forest_levels(src, dst, len(names), k)
        return pdf[[x < k for x in level]][columns]

    left, round_ = math.inf, 0
    while True:
        sizes = stored(links.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m")))
        total = sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
        if sizes.where(F.col("m") > IN_TASK_EDGES).isEmpty() or total > 0.8 * left:
            return links
        chunk = F.expr(f"pmod(xxhash64({round_}, src, dst), ceil(m / {IN_TASK_EDGES}))").alias("chunk")
        links = stored(links.join(sizes, "cluster_id").select(*columns, chunk).groupBy("cluster_id", "chunk").applyInPandas(thin, links.schema))
        left, round_ = total, round_ + 1


def halves_of(a: np.ndarray, b: np.ndarray, n: int, criterion: str) -> np.ndarray:
    """The side of each of n nodes by the most even minimum cut, from a certificate for cuts of fewer than k > f(n) edges; zeros if no cut is
    that small.  The certificate has all edges of such cuts, so its minimum cuts are those of the whole cluster."""
    cut, _ = edges_cut(a, b, np.ones(len(a)), n)
    return even_cut(a, b, n, cut).astype(np.int64) if cut <= bound(criterion, n) else np.zeros(n, np.int64)


def split_of(src: list[int], dst: list[int], n: int, k: int, criterion: str) -> list[int]:
    """The part of each of n nodes, from a certificate for cuts of fewer than k > f(n) edges; one part if no cut is that small.

    Trees of the last forest stay whole.  They are cut off while few edges leave them, each by a cut of the whole
    cluster, which is no smaller than the cut of what is left; where none is, the minimum cut parts the cluster in two."""
    level, tree = forest_levels(src, dst, n, k)
    roots = sorted(set(tree))
    if len(roots) == 1:
        return [0] * n
    at = {r: i for i, r in enumerate(roots)}
    group = [at[r] for r in tree]
    size = [0] * len(roots)
    for g in group:
        size[g] += 1
    links: Links = [{} for _ in roots]
    for a, b, x in zip(src, dst, level, strict=True):
        a, b = group[a], group[b]
        if a != b and x < k:
            links[a][b] = links[b][a] = links[a].get(b, 0.0) + 1.0
    part, left = [0] * len(roots), n
    degree = [sum(x.values()) for x in links]
    for g in sorted(range(len(roots)), key=lambda g: (degree[g], g)):
        if size[g] == left or degree[g] > bound(criterion, left):
            break
        part[g] = max(part) + 1
        left -= size[g]
    if left == n:
        cut, side = min_cut(links)
        if cut <= bound(criterion, n):
            for g in side:
                part[g] = 1
    return [part[g] for g in group]


def _parted(edges: DataFrame, whole: DataFrame, large: DataFrame, criterion: str, even: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of the clusters ``large`` (cluster_id, n): (node_id, piece) of those that no small cut parts, and (node_id, cluster_id) of
    the parts of the others, two of each if ``even``: the sides of its most even minimum cut."""
    order = large.select("cluster_id", (F.floor(criterion_column(criterion, F.col("n")) + 1e-9) + 1).cast("int").alias("k"))
    links = inside(edges, whole.join(large.select("cluster_id"), "cluster_id", "left_semi")).join(order, "cluster_id").select("cluster_id", "src", "dst", "k")
    node, kind = edges.schema["src"].dataType.simpleString(), whole.schema["cluster_id"].dataType.simpleString()

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        if even:
            names, a, b = numbered_arrays(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
            found = halves_of(a, b, len(names), criterion)
        else:
            names, src, dst = _places(pdf)
            found = split_of(src, dst, len(names), int(pdf["k"].iloc[0]), criterion)
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].iloc[0], "node_id": names, "part": found, "parts": max(found) + 1})

    found = stored(sparse_certificate(links).groupBy("cluster_id").applyInPandas(part, f"cluster_id {kind}, node_id {node}, part int, parts int"))
    kept = found.where("parts = 1")
    least = kept.groupBy("cluster_id").agg(F.min("node_id").alias("piece"))
    return kept.join(least, "cluster_id").select("node_id", "piece"), found.where("parts > 1").selectExpr("node_id", "concat_ws(' ', cluster_id, part) AS cluster_id")


def _apart(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """``links`` by cluster, in more partitions the more edges ``sizes`` (m) count."""
    parts = sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] // EDGES_IN_PART + 1
    return links.repartition(parts, "cluster_id")


def _binned(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """``links`` with ``bin``, by bin: small clusters share bins, others have their own; ``sizes`` (cluster_id, m) count their edges."""
    few = F.col("m") <= CUT_BIN_EDGES / 2
    shared, own = sizes.agg(F.coalesce(F.sum(F.when(few, F.col("m"))), F.lit(0)), F.coalesce(F.sum(F.when(~few, F.col("m"))), F.lit(0))).first()
    bins = shared // CUT_BIN_EDGES + 1
    held = sizes.select("cluster_id", F.when(few, F.pmod(F.xxhash64("cluster_id"), F.lit(bins))).otherwise(F.xxhash64("cluster_id", F.lit(1))).alias("bin"))
    return links.join(held, "cluster_id").repartition(bins + own // EDGES_IN_PART, "bin")


def well_connected_clusters(edges: DataFrame, clustering: DataFrame, criterion: str, recluster=None, regroup=None) -> DataFrame:
    """WCC (or CM with ``recluster``): clusters cut until each piece's minimum cut exceeds f(n).

    CM cuts at the most even of all minimum cuts, whatever the cluster's size, and groups both sides anew before they are judged.

    Clusters are first split into components, which is all that criteria below one ask for: those never
    reach Python.  Of the others one task cuts a cluster of at most ``IN_TASK_EDGES`` edges until all is done.  Larger ones are
    thinned to a sparse certificate, in chunks.  For WCC a task that holds this one finds the cut, or all the parts that hang
    on few edges; for CM it finds the most even cut, which is that of the whole cluster, and ``regroup`` (inside edges with cluster_id)
    groups the sides.  The parts come back to the first step.
    """
    node = edges.schema["src"].dataType.simpleString()

    def split(src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
        names, a, b = numbered_arrays(src, dst)
        ends, later = pieces_of(a, b, len(names), criterion, recluster, recluster is not None, ONCE_EDGES)
        pieces = ends + later
        at = np.concatenate([np.zeros(0, np.int64), *pieces])
        size = np.array([len(p) for p in pieces], np.int64)
        return [names[at], names[np.repeat(np.array([p.min() for p in pieces], np.int64), size)], np.repeat(np.arange(len(pieces)) < len(ends), size)]

    done = None
    while True:
        whole = stored(connected_clusters(edges, clustering))
        links = stored(inside(edges, whole))
        sizes = whole.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).join(links.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m")), "cluster_id")
        sizes = stored(sizes.withColumn("least", criterion_column(criterion, F.col("n"))))
        ready = whole.join(sizes.where("least < 1").select("cluster_id"), "cluster_id", "left_semi")
        least = ready.groupBy("cluster_id").agg(F.min("node_id").alias("piece"))
        small = sizes.where("least >= 1").where(F.col("m") <= IN_TASK_EDGES).select("cluster_id")
        cut = streamed(_apart(links.join(small, "cluster_id", "left_semi"), sizes), "cluster_id", ["src", "dst"], [], split, f"node_id {node}, piece {node}, ended boolean")
        cut = stored(cut)
        found = ready.join(least, "cluster_id").select("node_id", "piece").unionByName(cut.where("ended").drop("ended"))
        later = cut.where("NOT ended").select("node_id", F.col("piece").alias("cluster_id"))
        large = sizes.where("least >= 1").where(F.col("m") > IN_TASK_EDGES).select("cluster_id", "n")
        found = stored(found)
        done = found if done is None else done.unionByName(found)
        beyond = not large.isEmpty()
        if not beyond and later.isEmpty():
            return numbered(done)
        clustering = later
        if beyond:
            kept, parts = _parted(edges, whole, large, criterion, regroup is not None)
            done = done.unionByName(stored(kept))
            if regroup is not None:
                parts = regroup(stored(inside(edges, stored(parts))))
            names = F.concat(F.lit("p"), F.col("cluster_id").cast("string"))  # apart from the names of those that tasks cut
            clustering = later.withColumn("cluster_id", F.col("cluster_id").cast("string")).unionByName(parts.withColumn("cluster_id", names))


def cluster_cuts(edges: DataFrame, clustering: DataFrame) -> DataFrame:
    """(cluster_id, n, min_cut, cut_log, cut_sqrt): each cluster's least edge cut, 0 if it is not connected,
    and its ratio to log10(n) and sqrt(n) (0 for a single node).

    No cut is above the least degree, so a cluster of more than ``IN_TASK_EDGES`` edges is thinned to the certificate for the cuts up to that."""
    sizes = clustering.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        code, ids = pd.factorize(pdf["cluster_id"])
        order = np.argsort(code, kind="stable")
        src, dst = pdf["src"].to_numpy()[order], pdf["dst"].to_numpy()[order]
        ends, rows = np.cumsum(np.bincount(code)), []
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            if hi - lo == 1:
                rows.append((2, 1.0))
                continue
            places, names = pd.factorize(np.concatenate([src[lo:hi], dst[lo:hi]]))
            rows.append((len(names), edges_cut(places[: hi - lo], places[hi - lo :], np.ones(hi - lo), len(names))[0]))
        return pd.DataFrame({"cluster_id": ids, "joined": [n for n, _ in rows], "cut": [x for _, x in rows]})

    kind = clustering.schema["cluster_id"].dataType.simpleString()
    links = stored(inside(edges, clustering))
    counts = stored(links.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m")))
    large = counts.where(F.col("m") > IN_TASK_EDGES).select("cluster_id")
    if not large.isEmpty():
        ends = links.select("cluster_id", F.col("src").alias("v")).union(links.select("cluster_id", "dst")).join(large, "cluster_id", "left_semi")
        order = ends.groupBy("cluster_id", "v").count().groupBy("cluster_id").agg((F.min("count") + 1).cast("int").alias("k"))
        thinned = sparse_certificate(links.join(order, "cluster_id")).select("cluster_id", "src", "dst")
        links = links.join(large, "cluster_id", "left_anti").unionByName(thinned)
    found = _binned(links, counts).groupBy("bin").applyInPandas(cut, f"cluster_id {kind}, joined long, cut double")
    n = F.col("n")
    value = F.when(F.col("joined") == n, F.col("cut")).otherwise(0.0)
    ratio = lambda by: F.when(n > 1, value / by).otherwise(0.0)
    return sizes.join(found, "cluster_id", "left").select("cluster_id", "n", value.alias("min_cut"), F.round(ratio(F.log10(n)), 6).alias("cut_log"), F.round(ratio(F.sqrt(n)), 6).alias("cut_sqrt"))
