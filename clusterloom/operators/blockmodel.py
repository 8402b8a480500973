"""Stochastic block models: description lengths as DataFrame aggregates, and a distributed fit.

Description lengths follow the microcanonical models of Peixoto (2017) and Zhang and Peixoto (2020) over
undirected simple graphs: degree-corrected (``dc``, uniform degree prior), not degree-corrected (``ndc``)
and planted partition (``pp``).  Every term is a log-factorial of a count, so one grouped pass over the
block matrix and one over the blocks give the total; no table of log-factorials is needed.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.logmath import log_choose, log_factorial, log_multiset
from clusterloom.functions.measures import best_model
from clusterloom.operators.blocksearch import search
from clusterloom.operators.localmove import local_labels, prepared
from clusterloom.sources.edges import profile
from clusterloom.sources.jobs import side_by_side
from clusterloom.sources.storage import stored

MODELS = ("dc", "ndc", "pp")
#: Resolutions of the merge path that the fit chooses from by description length.
RESOLUTIONS = (0.25, 0.5, 1.0, 2.0, 4.0)


def description_length(edges: DataFrame, blocks: DataFrame, model: str, known_simple: bool = False) -> DataFrame:
    """One row (n, e, b, entropy) of the partition ``blocks`` (node_id, cluster_id) of all nodes.

    Nodes are those of the edges, isolated ones through self-loops included; the graph itself is simple.
    A node without a block raises nothing: it is a block of its own.  An empty graph has entropy 0.
    """
    return description_lengths(edges, blocks, (model,), known_simple).drop("ord", "model")


def description_lengths(edges: DataFrame, blocks: DataFrame, models: tuple[str, ...] = MODELS, known_simple: bool = False) -> DataFrame:
    """A row (ord, model, n, e, b, entropy) for each of ``models``: the graph is counted once for all, as ``description_length`` says.

    With ``known_simple`` the edges are pairs with src < dst, each once, and are not told apart again."""
    for model in models:
        if model not in MODELS:
            raise ValueError(f"unknown model {model!r}; one of {MODELS}")
    every = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).where("node_id IS NOT NULL").distinct()
    known = blocks.select("node_id", F.col("cluster_id").cast("string").alias("c"))
    label = stored(every.join(known, "node_id", "left").select("node_id", F.coalesce(F.concat(F.lit("c"), "c"), F.concat(F.lit("n"), F.col("node_id").cast("string"))).alias("block")))
    simple = edges.select("src", "dst") if known_simple else stored(profile(edges, "simple").select("src", "dst"))  # the matrix and the degrees read it
    a = label.select(F.col("node_id").alias("src"), F.col("block").alias("r"))
    b = label.select(F.col("node_id").alias("dst"), F.col("block").alias("s"))
    cells = stored(simple.join(a, "src").join(b, "dst").groupBy(F.least("r", "s").alias("r"), F.greatest("r", "s").alias("s")).agg(F.count(F.lit(1)).alias("m")))
    inner, m = F.col("r") == F.col("s"), F.col("m")
    sums = cells.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("e"), F.coalesce(F.sum(F.when(inner, m)), F.lit(0)).alias("e_in"),
        F.coalesce(F.sum(F.when(inner, log_factorial(m) + m * F.log(F.lit(2.0))).otherwise(log_factorial(m))), F.lit(0.0)).alias("e0"),
    )
    ends = cells.select(F.col("r").alias("block"), "m").union(cells.select("s", "m")).groupBy("block").agg(F.sum("m").alias("er"))
    sizes = label.groupBy("block").agg(F.count(F.lit(1)).alias("nr")).join(ends, "block", "left").fillna(0, ["er"])
    nr, er = F.col("nr"), F.col("er")
    some = lambda c, name: F.coalesce(F.sum(c), F.lit(0.0)).alias(name)
    per_block = sizes.agg(
        F.count(F.lit(1)).alias("b"), F.coalesce(F.sum("nr"), F.lit(0)).alias("n"), some(log_factorial(nr), "lf_n"), some(log_factorial(er), "lf_e"),
        some(log_multiset(nr, er), "degrees"), some(er * F.log(nr.cast("double")), "spread"), some(log_factorial(nr - 1) - log_factorial(er + nr - 1), "pp"),
    )
    k = simple.select(F.col("src").alias("v")).union(simple.select("dst")).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    node = k.agg(some(log_factorial(F.col("k")), "lf_k"))
    t = sums.join(F.broadcast(per_block)).join(F.broadcast(node))  # one row each
    n, e, nb, e_in = (F.col(c) for c in ("n", "e", "b", "e_in"))
    prior = F.col("lf_n") - log_factorial(n) - log_choose(n - 1, nb - 1) - F.log(n.cast("double"))
    edge_prior = -log_multiset((nb * (nb + 1) / 2).cast("long"), e)

    def length(model: str) -> Column:
        if model == "dc":
            fit = F.col("e0") + F.col("lf_k") - F.col("lf_e") + edge_prior - F.col("degrees")
        elif model == "ndc":
            fit = F.col("e0") - F.col("spread") + edge_prior
        else:
            out = e - e_in
            across = F.when(nb > 1, out * F.log(nb * (nb - 1) / 2.0) + F.log(e + 1.0)).otherwise(0.0)
            fit = log_factorial(e_in) + log_factorial(out) - e_in * F.log(nb / 2.0) - across + F.col("pp") + F.col("lf_k")
        return F.when(n > 0, -fit - prior).otherwise(0.0)

    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(model).alias("model"), length(model).alias("entropy")) for i, model in enumerate(models)])
    return t.select("n", "e", "b", F.explode(each).alias("x")).select("x.ord", "x.model", "n", "e", "b", "x.entropy")


def candidates(edges: DataFrame, seed: int = 1234) -> list[DataFrame]:
    """Partitions (node_id, cluster_id) of every node, each kept as a table: one block of all nodes, then
    those of the local moves at each of ``RESOLUTIONS``."""
    every = stored(edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).where("node_id IS NOT NULL").distinct())
    ready = prepared(edges)

    def of(resolution: float) -> DataFrame:
        label = local_labels(ready, "mod", resolution, seed)
        return stored(every.join(label, "node_id", "left").select("node_id", F.coalesce("piece", "node_id").cast("string").alias("cluster_id")))

    return [every.withColumn("cluster_id", F.lit("all")), *side_by_side([partial(of, resolution) for resolution in RESOLUTIONS])]


def fit_blocks(edges: DataFrame, model: str, seed: int = 1234, tried: list[DataFrame] | None = None) -> tuple[DataFrame, float]:
    """(node_id, cluster_id) of every node, and its description length: what the search of the block matrix finds,
    never longer than the least of the candidates."""
    blocks = stored(search(edges, model, seed, candidates(edges, seed) if tried is None else tried))
    return blocks, description_length(edges, blocks, model).first()["entropy"]


def best_blocks(edges: DataFrame, models: tuple[str, ...] = MODELS, seed: int = 1234) -> tuple[str, DataFrame, DataFrame]:
    """The winning model's name, its blocks, and the (ord, model, entropy) table of all candidates."""
    edges = stored(edges)
    tried = candidates(edges, seed)
    fits = dict(zip(models, side_by_side([partial(fit_blocks, edges, model, seed, tried) for model in models]), strict=True))
    table = edges.sparkSession.createDataFrame([(i, k, fits[k][1]) for i, k in enumerate(models)], "ord int, model string, entropy double")
    winner = best_model(table).first()["model"]
    return winner, fits[winner][0], table


#: Resolutions of the local moves that group blocks on the levels above.
UPPER = (0.25, 1.0)
#: Models with a nested form.
NESTED = ("dc", "ndc")


def _top(blocks: int, edges: int) -> float:
    """Length of the block matrix of ``blocks`` blocks where one group holds them all."""
    places = blocks * (blocks + 1) / 2
    return math.log(blocks) + math.lgamma(places + edges) - math.lgamma(edges + 1) - math.lgamma(places) if blocks else 0.0


def block_matrix(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, dst, weight): weight between and inside the blocks (node_id, cluster_id) of the edges' nodes."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    a = blocks.select(F.col("node_id").alias("src"), F.col("cluster_id").alias("r"))
    b = blocks.select(F.col("node_id").alias("dst"), F.col("cluster_id").alias("s"))
    both = edges.select("src", "dst", weight.alias("weight")).join(a, "src").join(b, "dst")
    return both.groupBy(F.least("r", "s").alias("src"), F.greatest("r", "s").alias("dst")).agg(F.sum("weight").alias("weight"))


def level_length(groups: DataFrame, above: DataFrame) -> tuple[int, float]:
    """Number of groups, and the length of a block matrix under ``groups`` (node_id, cluster_id) of its blocks
    when ``above``, the matrix of the groups, is known: all multigraphs with those counts are alike."""
    sizes = groups.groupBy(F.col("cluster_id").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    cells = above.join(sizes.select(F.col("g").alias("src"), F.col("n").alias("nr")), "src").join(sizes.select(F.col("g").alias("dst"), F.col("n").alias("ns")), "dst")
    places = F.when(F.col("src") == F.col("dst"), (F.col("nr") * (F.col("nr") + 1) / 2).cast("long")).otherwise(F.col("nr") * F.col("ns"))
    fit = cells.agg(F.coalesce(F.sum(log_multiset(places, F.col("weight").cast("long"))), F.lit(0.0)).alias("fit"))
    n = F.col("n")
    row = sizes.agg(F.count(F.lit(1)).alias("b"), F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.coalesce(F.sum(log_factorial(n)), F.lit(0.0)).alias("lf")).join(F.broadcast(fit)).first()  # one row each
    if not row["n"]:
        return 0, 0.0
    choose = math.lgamma(row["n"]) - math.lgamma(row["b"]) - math.lgamma(row["n"] - row["b"] + 1)
    return row["b"], row["fit"] - row["lf"] + math.lgamma(row["n"] + 1) + choose + math.log(row["n"])


def hierarchy(matrix: DataFrame, blocks: DataFrame, n_blocks: int, n_edges: int, seed: int = 1234) -> tuple[list[DataFrame], float]:
    """Groups (node_id, cluster_id) of the blocks (node_id) level by level, and the length of the matrix under them.

    A level is added while it shortens the description; each has fewer groups than the one below."""
    levels: list[DataFrame] = []
    paid = 0.0
    while n_blocks > 2:
        ready, tried = prepared(matrix), []
        for resolution in UPPER:
            label = local_labels(ready, "mod", resolution, seed)
            groups = stored(blocks.join(label, "node_id", "left").select("node_id", F.coalesce("piece", "node_id").cast("string").alias("cluster_id")))
            above = stored(block_matrix(matrix, groups))
            b, length = level_length(groups, above)
            if b < n_blocks:
                tried.append((length + _top(b, n_edges), b, length, groups, above))
        if not tried:
            break
        best, b, length, groups, above = min(tried, key=lambda x: x[:2])
        if best >= _top(n_blocks, n_edges):
            break
        levels.append(groups)
        paid, n_blocks, matrix = paid + length, b, above
        blocks = groups.select(F.col("cluster_id").alias("node_id")).distinct()
    return levels, paid + _top(n_blocks, n_edges)


def nested_blocks(edges: DataFrame, model: str, seed: int = 1234, tried: list[DataFrame] | None = None) -> tuple[list[DataFrame], float]:
    """Levels of (node_id, cluster_id), the nodes' blocks first, and the nested description length.

    The edge prior of the flat model gives way to a hierarchy of groups of blocks.  Level 0 is, of the candidates of the flat fit and
    of what it finds, the one that is shortest with its hierarchy, the coarser on a tie; an empty graph has length 0."""
    if model not in NESTED:
        raise ValueError(f"no nested form of {model!r}; one of {NESTED}")
    edges = stored(edges)
    simple = stored(profile(edges, "simple"))
    tried = tried or candidates(edges, seed)

    def under(i: int, blocks: DataFrame) -> tuple[float, int, list[DataFrame]]:
        flat = description_length(edges, blocks, model).first()
        matrix = stored(block_matrix(simple, blocks))
        every = blocks.select(F.col("cluster_id").alias("node_id")).distinct()
        levels, length = hierarchy(matrix, every, flat["b"], flat["e"], seed)
        flat_prior = _top(flat["b"], flat["e"]) - (math.log(flat["b"]) if flat["b"] else 0.0)
        return flat["entropy"] - flat_prior + length, i, [blocks, *levels]

    starts = [partial(under, i, blocks) for i, blocks in enumerate(tried)]
    found = side_by_side([*starts, lambda: under(len(tried), stored(search(edges, model, seed, tried)))])
    length, _, levels = min(found, key=lambda x: x[:2])
    return levels, length
