"""Search for the blocks of a stochastic block model: merges and moves along the block matrix.

The state is three tables: the edges from each node to each block, the block matrix, and the blocks' sizes.  Every
round proposes changes, takes the exact change of the description length of each by joins with the matrix, and
makes many changes at once.  A batch whose changes together lengthen the description is tried again with fewer of
them, at last with the best one alone, so no round of moves ever lengthens it.

From each node alone, blocks merge (a block joins another that waits) until one block is left; at every halving nodes
move.  The shortest state on the way is moved and merged on until neither shortens it.

What is proposed follows the matrix: from a node, or block, to a block that it has edges with, and from there to a block that this
one has edges with, both drawn by their number of edges; so blocks of alike neighbours meet also where they have no
edge in common.  One proposal is drawn evenly from all blocks, as separate parts of a graph share no path.
A graph of at most ``IN_TASK_EDGES`` edges is searched in a task, by the same steps over arrays (``blockarrays``).  Of a larger one
joined rounds merge blocks until the matrix fits a task; the shortest state found there is settled node by node by joined rounds.
All draws are hashes of names, seed and round, so a run can be repeated and a lost task gives the same rows again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.blockarrays import Search, Units
from clusterloom.operators.graph import dense_index
from clusterloom.sources.edges import profile
from clusterloom.sources.jobs import side_by_side
from clusterloom.sources.storage import stored

MODELS = ("dc", "ndc", "pp")
#: Proposals along the matrix for each node and each block, and to neighbouring blocks among them.
NODE_DRAWS, BLOCK_DRAWS, DIRECT = 3, 5, 2
#: Parts of the moves that are tried together, one after the other where a larger part lengthens the description.
PARTS = (0.5, 0.125, 0.03125)
#: On the way down, nodes move until a round shortens the description by less than this part.
SETTLED = 5e-3
#: A round counts as progress if it shortens the description by this part at least.
PROGRESS = 1e-6
#: Edges, or cells of the block matrix, of what one task searches.
IN_TASK_EDGES = 1_000_000


def _lf(n: str) -> str:
    """SQL of ln n! without branches: Stirling's series at n + 8."""
    n = f"({n})"
    below = " * ".join(f"({n} + {k}D)" for k in range(1, 9))
    x = f"({n} + 9D)"
    return f"(({x} - 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}) + 1 / (1260 * {x} * {x} * {x} * {x} * {x}) - ln({below}))"


def _inner(m: str) -> str:
    """SQL: of m edges within a block."""
    return f"({_lf(m)} + ({m}) * {math.log(2.0)!r}D)"


def _block(model: str, n: str, e: str) -> str:
    """SQL: what a block of n nodes and e ends adds; 0 for no nodes."""
    if model == "dc":
        found = f"{_lf(f'{n} + {e} - 1')} - {_lf(n)} - {_lf(f'{n} - 1')}"
    elif model == "ndc":
        found = f"({e}) * ln({n}) - {_lf(n)}"
    else:
        found = f"{_lf(f'{e} + {n} - 1')} - {_lf(f'{n} - 1')} - {_lf(n)}"
    return f"(CASE WHEN {n} > 0 THEN {found} ELSE 0D END)"


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 < k < n else 0.0


def _prior(model: str, b: int, n: int, e: int) -> float:
    """What the number of blocks adds by itself; the edge prior of ``pp`` is apart, as it counts the edges within."""
    if not b:
        return 0.0
    places = b * (b + 1) // 2
    edges = 0.0 if model == "pp" else _log_choose(places + e - 1, e)
    return edges + math.lgamma(n + 1) + _log_choose(n - 1, b - 1) + math.log(n)


def _planted(b: int, e: int, inner: str) -> str:
    """SQL, ``pp``: what ``inner`` of e edges within b blocks add."""
    out = f"({e} - ({inner}))"
    across = f"{out} * {math.log(b * (b - 1) / 2)!r}D + {math.log(e + 1)!r}D" if b > 1 else "0D"
    return f"(({inner}) * {math.log(b / 2)!r}D + {across} - {_lf(inner)} - {_lf(out)})"


@dataclass(frozen=True)
class Graph:
    """``links`` (node, near), both directions of the simple edges; ``nodes`` (node, k); numbers of nodes and edges."""

    model: str
    seed: int
    links: DataFrame
    nodes: DataFrame
    n: int
    e: int


@dataclass(frozen=True)
class State:
    """``label`` (node, block) and ``near`` (node, r, u, d), the edges from a node of block r to block u, are written; summed
    from them are ``cells`` (r, u, m), the matrix, inner edges counted twice, and ``blocks`` (block, n, e, inner).
    The number of blocks, inner edges and the length are known."""

    label: DataFrame
    near: DataFrame
    cells: DataFrame
    blocks: DataFrame
    b: int
    within: int
    length: float


def state_of(g: Graph, label: DataFrame) -> State:
    """The tables behind a partition of all nodes and its description length, but for what the graph alone adds."""
    ends = g.links.join(label.selectExpr("node AS near", "block AS u"), "near")
    near = stored(ends.groupBy("node", "u").agg(F.expr("count(1) AS d")).join(label.withColumnRenamed("block", "r"), "node").select("node", "r", "u", "d"))
    cells = near.groupBy("r", "u").agg(F.expr("sum(d) AS m"))
    sizes = label.join(g.nodes, "node").groupBy("block").agg(F.expr("count(1) AS n"), F.expr("sum(k) AS e"))
    blocks = sizes.join(cells.where("r = u").selectExpr("r AS block", "m"), "block", "left").selectExpr("block", "n", "e", "coalesce(m div 2, 0) AS inner")
    matrix = cells.selectExpr(f"-sum(CASE WHEN r = u THEN {_inner('m / 2')} ELSE {_lf('m')} / 2 END) AS x", "CAST(null AS BIGINT) AS b", "CAST(null AS BIGINT) AS w")
    rows = blocks.selectExpr(f"sum({_block(g.model, 'n', 'e')}) AS x", "count(1) AS b", "sum(inner) AS w")
    found = {row["b"] is None: row for row in rows.unionByName(matrix).collect()}  # one row each
    (of_blocks, b, within), of_cells = found[False], found[True]["x"] or 0.0
    if g.model == "pp":
        of_cells = g.nodes.sparkSession.range(1).selectExpr(_planted(b, g.e, f"{within}")).first()[0]
    return State(label, near, cells, blocks, b, within, of_blocks + of_cells + _prior(g.model, b, g.n, g.e))


def _even(seed: int, round_: int, *names: str) -> str:
    """SQL of a number in (0, 1) drawn by hashing."""
    return f"((pmod(xxhash64({seed}, {round_}, {', '.join(names)}), {1 << 52}L) + 0.5D) / {1 << 52}D)"


def _drawn(rows: DataFrame, key: str, to: str, weight: str, draws: int, seed: int, round_: int) -> DataFrame:
    """(key, slot, to): in each slot one of the key's rows, by weight: the first arrival of exponential waiting times."""
    picks = ", ".join(f"min_by({to}, -ln({_even(seed, round_, str(k), key, to)}) / {weight})" for k in range(draws))
    return rows.groupBy(key).agg(F.expr(f"array({picks}) AS p")).selectExpr(key, f"posexplode(p) AS (slot, {to})")


def _others(g: Graph, s: State, names: DataFrame, key: str, round_: int) -> DataFrame:
    """(key, t): one block for each name, drawn evenly."""
    buckets = max(1, s.b // 2)
    place = lambda c: f"pmod(xxhash64({g.seed}, {round_}, 'any', {c}), {buckets}) AS bucket"
    heads = s.blocks.selectExpr("block", place("block"), f"{_even(g.seed, round_, 'block')} AS x").groupBy("bucket").agg(F.expr("min_by(block, x) AS t"))
    return names.selectExpr(key, place(f"concat('n', {key})")).join(heads, "bucket").select(key, "t")


def _proposed(g: Graph, s: State, rows: DataFrame, key: str, weight: str, draws: int, names: DataFrame, round_: int) -> DataFrame:
    """Distinct (key, t): along the matrix, to neighbouring blocks, and to any block."""
    picks = _drawn(rows, key, "u", weight, draws, g.seed, round_)
    onward = _drawn(s.cells.selectExpr("r AS v", "u AS t", "m"), "v", "t", "m", draws, g.seed + 1, round_)
    steps = picks.join(onward.withColumnRenamed("v", "u"), ["u", "slot"]).select(key, "t")
    direct = picks.where(f"slot < {DIRECT}").selectExpr(key, "u AS t")
    return steps.unionByName(direct).unionByName(_others(g, s, names, key, round_)).distinct()


def _ends(s: State, side: str) -> DataFrame:
    return s.blocks.selectExpr(f"block AS {side}", f"n AS n_{side}", f"e AS e_{side}", f"inner AS in_{side}")


def move_changes(g: Graph, s: State, asked: DataFrame) -> DataFrame:
    """(node, r, t, change): what each move (node, t) to another block adds to the length, by itself."""
    moves = asked.join(s.label.withColumnRenamed("block", "r"), "node").where("t <> r")
    rows = moves.join(s.near.select("node", "u", "d"), "node", "left")
    rows = rows.join(s.cells.withColumnRenamed("m", "m_ru"), ["r", "u"], "left")
    rows = rows.join(s.cells.selectExpr("r AS t", "u", "m AS m_tu"), ["t", "u"], "left").fillna(0, ["d", "m_ru", "m_tu"])
    step = f"{_lf('m_ru - d')} - {_lf('m_ru')} + {_lf('m_tu + d')} - {_lf('m_tu')}" if g.model != "pp" else "0D"
    sums = rows.groupBy("node", "r", "t").agg(
        F.expr(f"sum(CASE WHEN d > 0 AND u <> r AND u <> t THEN {step} ELSE 0D END) AS side"), F.expr("coalesce(max(CASE WHEN u = t THEN m_ru WHEN u = r THEN m_tu END), 0) AS m_rt"),
        F.expr("sum(CASE WHEN u = r THEN d ELSE 0 END) AS d_r"), F.expr("sum(CASE WHEN u = t THEN d ELSE 0 END) AS d_t"),
    )
    x = sums.join(_ends(s, "r"), "r").join(_ends(s, "t"), "t").join(g.nodes, "node")
    fewer = _prior(g.model, s.b - 1, g.n, g.e) - _prior(g.model, s.b, g.n, g.e)
    change = [_block(g.model, "(n_r - 1)", "(e_r - k)"), f"-{_block(g.model, 'n_r', 'e_r')}", _block(g.model, "(n_t + 1)", "(e_t + k)"), f"-{_block(g.model, 'n_t', 'e_t')}", f"CASE WHEN n_r = 1 THEN {fewer!r}D ELSE 0D END"]
    if g.model == "pp":
        inner = f"({s.within} + d_t - d_r)"
        change += [f"CASE WHEN n_r = 1 THEN {_planted(max(1, s.b - 1), g.e, inner)} ELSE {_planted(s.b, g.e, inner)} END", f"-{_planted(s.b, g.e, f'{s.within}')}"]
    else:
        change += ["-side", f"-{_inner('in_r - d_r')}", _inner("in_r"), f"-{_inner('in_t + d_t')}", _inner("in_t"), f"-{_lf('m_rt + d_r - d_t')}", _lf("m_rt")]
    return x.selectExpr("node", "r", "t", f"{' + '.join(f'({c})' for c in change)} AS change")


def merge_changes(g: Graph, s: State, asked: DataFrame) -> DataFrame:
    """(r, t, change): what each merge of block r into t adds to the length, by itself."""
    rows = asked.join(s.cells.withColumnRenamed("m", "m_ru"), "r", "left")
    rows = rows.join(s.cells.selectExpr("r AS t", "u", "m AS m_tu"), ["t", "u"], "left").fillna(0, ["m_ru", "m_tu"])
    step = f"{_lf('m_ru + m_tu')} - {_lf('m_ru')} - {_lf('m_tu')}" if g.model != "pp" else "0D"
    sums = rows.groupBy("r", "t").agg(F.expr(f"sum(CASE WHEN u <> r AND u <> t AND m_ru > 0 AND m_tu > 0 THEN {step} ELSE 0D END) AS side"), F.expr("coalesce(max(CASE WHEN u = t THEN m_ru END), 0) AS m_rt"))
    x = sums.join(_ends(s, "r"), "r").join(_ends(s, "t"), "t")
    fewer = _prior(g.model, s.b - 1, g.n, g.e) - _prior(g.model, s.b, g.n, g.e)
    change = [_block(g.model, "(n_r + n_t)", "(e_r + e_t)"), f"-{_block(g.model, 'n_r', 'e_r')}", f"-{_block(g.model, 'n_t', 'e_t')}", f"{fewer!r}D"]
    if g.model == "pp":
        change += [_planted(max(1, s.b - 1), g.e, f"{s.within} + m_rt"), f"-{_planted(s.b, g.e, f'{s.within}')}"]
    else:
        change += ["-side", f"-{_inner('in_r + in_t + m_rt')}", _inner("in_r"), _inner("in_t"), _lf("m_rt")]
    return x.selectExpr("r", "t", f"{' + '.join(f'({c})' for c in change)} AS change")


def _best(changes: DataFrame, key: str, to: str) -> DataFrame:
    return changes.groupBy(key).agg(F.expr(f"min(struct(change, {to})) AS b")).selectExpr(key, f"b.{to}", "b.change")


def moved(g: Graph, s: State, round_: int) -> State | None:
    """The state after a round of moves that shortens the description; None if none of the proposed moves does."""
    if s.b < 2:
        return None
    asked = _proposed(g, s, s.near, "node", "d", NODE_DRAWS, s.label.select("node"), round_)
    best = stored(_best(move_changes(g, s, asked), "node", "t").where("change < -1e-9"))
    if best.isEmpty():
        return None
    turn = _even(g.seed + 2, round_, "node")
    for some in (*(best.where(f"{turn} < {part}") for part in PARTS), best.orderBy("change", "node").limit(1)):
        label = stored(s.label.join(some.select("node", "t"), "node", "left").selectExpr("node", "coalesce(t, block) AS block"))
        found = state_of(g, label)
        if found.length < s.length - 1e-9:
            return found
    return None


def merged(g: Graph, s: State, round_: int, shorter: bool = False) -> State | None:
    """The state after a batch of merges, those that shorten the description only if ``shorter``; None if there are none.

    A hashed half of the blocks waits; each other block joins the best of the proposed waiting ones.  If they do not
    shorten it together, each waiting block takes the best that asks, at last only the best pair merges."""
    if s.b < 2:
        return None
    waits = lambda c: _even(g.seed + 3, round_, c)
    asked = _proposed(g, s, s.cells, "r", "m", BLOCK_DRAWS, s.blocks.selectExpr("block AS r"), round_).where(f"{waits('r')} >= 0.5 AND {waits('t')} < 0.5")
    change = merge_changes(g, s, asked)
    if shorter:
        change = change.where("change < -1e-9")
    joins = _best(change, "r", "t").withColumnRenamed("r", "block")
    if not shorter:
        found = _joined(g, s, joins)
        return found if found.b < s.b else None
    joins = stored(joins)
    one_each = _best(joins.withColumnRenamed("block", "r"), "t", "r").withColumnRenamed("r", "block")
    for some in (joins, one_each, joins.orderBy("change", "block").limit(1)):
        found = _joined(g, s, some)
        if found.b == s.b:
            return None
        if found.length < s.length - 1e-9:
            return found
    return None


def _joined(g: Graph, s: State, joins: DataFrame) -> State:
    return state_of(g, stored(s.label.join(joins.select("block", "t"), "block", "left").selectExpr("node", "coalesce(t, block) AS block")))


def settled(g: Graph, s: State, round_: int = 10_000, moved: Callable = moved, merged: Callable = merged) -> State:
    """Moved, and where moves make no progress merged, until twice in a row neither does."""
    still = 0
    while still < 2:
        before = s.length
        s = moved(g, s, round_) or s
        if s.length > before - PROGRESS * abs(before):
            s = merged(g, s, round_, shorter=True) or s
        round_ += 1
        still = 0 if s.length < before - PROGRESS * abs(before) else still + 1
    return s


def path(g: Graph, s: State, round_: int = 1, moved: Callable = moved, merged: Callable = merged) -> Iterator[State]:
    """The states on the way of merges down to one block; nodes move at each halving of the blocks."""
    swept, idle = s.b, 0
    yield s
    while s.b > 1 and idle < 40:  # two blocks meet with one waiting in every second round
        step = merged(g, s, round_)
        idle = 0 if step else idle + 1
        s = step or s
        if step and (s.b <= 0.6 * swept or s.b <= 4):
            swept, further = s.b, moved(g, s, round_)
            while further:  # the fewer the blocks, the more rounds until the nodes have found theirs
                done = s.length - further.length < SETTLED * abs(s.length)
                s, round_ = further, round_ + 1
                further = None if done else moved(g, s, round_)
        if step:
            yield s
        round_ += 1


def _shortest(states: Iterator[State]) -> State:
    return min(states, key=lambda s: (s.length, s.b))


def searched(g: Units, starts: list[np.ndarray]) -> np.ndarray:
    """The block of each unit: the shortest of the path's states and of ``starts``, settled."""
    steps = Search(_prior, NODE_DRAWS, BLOCK_DRAWS, DIRECT)
    both = {"moved": steps.moved, "merged": steps.merged}
    ways = [_shortest(path(g, steps.state(g, np.arange(len(g.size))), **both)), *(steps.state(g, start) for start in starts)]
    return settled(g, _shortest(ways), **both).label


def search_in_task(g: Graph, units: DataFrame, links: DataFrame, starts: list[DataFrame]) -> DataFrame:
    """(unit, block): ``units`` (unit, n, e, inner) with ``links`` (a, b, m), each pair once, searched in one task.

    ``starts`` are partitions (node, block) of the units.  Names are sorted there, so a lost task gives the same rows again."""
    model, seed, n, e, count = g.model, g.seed, g.n, g.e, len(starts)

    def run(key: tuple, units: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own = units[units["start"] < 0].sort_values("unit")
        names = own["unit"].to_numpy()
        links = links.sort_values(["a", "b"])
        a, b = (np.searchsorted(names, links[c].to_numpy()) for c in "ab")
        graph = Units(model, seed, *(own[c].to_numpy() for c in ("n", "e", "inner")), a, b, links["m"].to_numpy(), n, e)
        labels = [units[units["start"] == i].sort_values("unit")["n"].to_numpy() for i in range(count)]
        return pd.DataFrame({"unit": names, "block": names[searched(graph, labels)]})

    rows = units.selectExpr("0 AS task", "-1 AS start", "unit", "n", "e", "inner")
    for i, start in enumerate(starts):
        rows = rows.unionByName(start.selectExpr("0 AS task", f"{i} AS start", "node AS unit", "block AS n", "0L AS e", "0L AS inner"))
    return stored(rows.groupBy("task").cogroup(links.selectExpr("0 AS task", "a", "b", "m").groupBy("task")).applyInPandas(run, "unit long, block long"))


def simple_graph(edges: DataFrame, model: str, seed: int = 1234) -> tuple[Graph, DataFrame]:
    """The graph with nodes as numbers, and (node, node_id) that names them; isolated nodes by self-loops included."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; one of {MODELS}")
    every = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).where("node_id IS NOT NULL").distinct()
    ids = stored(dense_index(every, ["node_id"], "node").select(F.col("node").cast("long").alias("node"), "node_id"))
    one = profile(edges, "simple").join(ids.select(F.col("node_id").alias("src"), F.col("node").alias("a")), "src").join(ids.select(F.col("node_id").alias("dst"), F.col("node").alias("b")), "dst")
    one = one.select(F.col("a").alias("node"), F.col("b").alias("near"))
    links = stored(one.union(one.select("near", "node")))
    k = links.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    nodes = stored(ids.select("node").join(k, "node", "left").fillna(0, ["k"]))
    return Graph(model, seed, links, nodes, nodes.count(), links.count() // 2), ids


def search(edges: DataFrame, model: str, seed: int = 1234, starts: list[DataFrame] | None = None) -> DataFrame:
    """(node_id, cluster_id) of every node: the shortest description found; ``cluster_id`` is text.

    ``starts``: partitions (node_id, cluster_id) of all nodes; the shortest of them and of the path is settled, so the result is never longer than any of them.
    An empty graph gives no rows."""
    g, ids = simple_graph(edges, model, seed)
    if not g.n:
        return ids.select("node_id", F.col("node").cast("string").alias("cluster_id"))

    def given(start: DataFrame) -> DataFrame:
        named = ids.join(start.select("node_id", F.col("cluster_id").alias("c")), "node_id", "left")
        named = named.select("node", F.coalesce(F.concat(F.lit("c"), F.col("c").cast("string")), F.concat(F.lit("n"), F.col("node").cast("string"))).alias("c"))
        names = named.groupBy("c").agg(F.min("node").alias("block"))
        return stored(named.join(names, "c").select("node", "block"))

    begun = side_by_side([partial(given, start) for start in starts or []])
    alone = g.nodes.selectExpr("node", "node AS block")
    if g.e <= IN_TASK_EDGES:
        label = search_in_task(g, g.nodes.selectExpr("node AS unit", "1L AS n", "k AS e", "0L AS inner"), g.links.where("node < near").selectExpr("node AS a", "near AS b", "1L AS m"), begun)
        label = label.withColumnRenamed("unit", "node")
    else:
        ways = side_by_side([lambda: contracted(g, state_of(g, alone)), *(partial(state_of, g, start) for start in begun)])
        label = settled(g, _shortest(ways)).label
    return label.join(ids, "node").select("node_id", F.col("block").cast("string").alias("cluster_id"))


def contracted(g: Graph, s: State, round_: int = 1) -> State:
    """Blocks merged by joined rounds until a task holds the matrix, and searched there as units."""
    while s.b > 1 and s.cells.where("r < u").count() > IN_TASK_EDGES:
        s = merged(g, s, round_) or s
        round_ += 1
    found = search_in_task(g, s.blocks.selectExpr("block AS unit", "n", "e", "inner"), s.cells.where("r < u").selectExpr("r AS a", "u AS b", "m"), [])
    label = s.label.join(found.withColumnRenamed("block", "to").withColumnRenamed("unit", "block"), "block")
    return state_of(g, stored(label.select("node", F.col("to").alias("block"))))
