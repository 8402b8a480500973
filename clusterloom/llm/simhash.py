"""SimHash near-duplicates linked through a Gray-order hierarchical index.

Fingerprints: XXH64 (seed 42) of word shingles, majority bit by bit.  Equal fingerprints are one
node.  Two fingerprints that differ in at most two bits agree on at least two of four 16-bit blocks,
so each is dealt to six groups, one for each pair of blocks; a group above ``SPLIT`` members is
dealt on by two of four 8-bit pieces of the other 32 bits, after which a group can hold 2**16
fingerprints at most, whatever the corpus.  Groups of one member end there.

Inside a task the groups form one index: members sorted by group and Gray rank, ``FANOUT`` of them
under a node, nodes under nodes.  A node stores the bits on which all its members agree beyond what
its parent holds; a query accumulates the differences on the way down and leaves a whole group once
they exceed the limit.  Nodes whose members cannot differ in more bits than the limit are linked at
once, and a query skips nodes that are already in its component, so links are spanning links and
never all pairs.

Defined cases: null or empty texts have fingerprint zero and link like any other; a null id takes
part in linking and its component is the smallest id reached, null where there is none; an empty
table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm.common import raw, slices, text_frame, word_pieces
from clusterloom.operators.components import connected_components
from clusterloom.sources.storage import stored

SHINGLE = 3
SEED = 42
LIMIT = 2
SPLIT = 4096
FANOUT = 8
QUERIES = 4096  # queries that walk the index together


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes, as an unsigned 64-bit number; long texts go piece by piece."""
    digest, tail = xxhash.xxh64_intdigest, []
    ones, total = np.zeros(64, np.int64), 0
    for words in word_pieces(text.lower()):
        words = [*tail, *words]
        if shingle == 3:
            hashes = [digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])]
        else:
            hashes = [digest(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(shingle)))]
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint(t, shingle) for t in raw(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "fp"])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence: prefix XOR of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Forest:
    """Disjoint sets over 0..n-1, merged by arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


class GrayIndex:
    """Hierarchical index of codes inside groups; ``group`` numbers are ascending."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes, group = codes[self.order], group[self.order]
        lo, hi, of, first, last = self.codes, self.codes, group, np.arange(len(codes)), np.arange(len(codes))
        self.levels = []  # from the leaves up: agreed mask, pattern, first and last member, first and last child
        child = first
        self.levels.append((np.full(len(codes), ~np.uint64(0)), lo, first, last, child, child))
        while len(of) > len(np.unique(of)):
            new = np.concatenate(([True], of[1:] != of[:-1]))
            begin = np.flatnonzero(new)
            within = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
            cut = np.flatnonzero(within % FANOUT == 0)
            ends = np.append(cut[1:], len(of)) - 1
            lo, hi = np.bitwise_and.reduceat(lo, cut), np.bitwise_or.reduceat(hi, cut)
            of, first, last = of[cut], first[cut], last[ends]
            self.levels.append((~(lo ^ hi), lo, first, last, cut, ends))
        self.root = np.searchsorted(of, group)  # each member's group node on the top level

    def links(self, limit: int) -> np.ndarray:
        """Component label of every member (a member's place), joined where codes differ in at most ``limit`` bits."""
        n = len(self.codes)
        sets = _Forest(n)
        for mask, _, first, last, _, _ in self.levels[1:]:
            tight = np.bitwise_count(~mask) <= limit
            a, b = first[tight], last[tight]
            if len(a):
                size = b - a + 1
                ends = np.cumsum(size)
                sets.merge(np.repeat(a, size), np.repeat(a - ends + size, size) + np.arange(int(ends[-1])))
        for begin in range(0, n, QUERIES):
            q = np.arange(begin, min(n, begin + QUERIES))
            self._walk(q, limit, sets)
        return sets.label

    def _walk(self, q: np.ndarray, limit: int, sets: _Forest) -> None:
        node, acc = self.root[q], np.zeros(len(q), np.int64)
        held = np.zeros(len(q), np.uint64)  # the bits already counted
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, pattern, first, last, child, child_end = self.levels[depth]
            acc = acc + np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node] & ~held)
            near = (acc <= limit) & (last[node] > q)  # each pair from its earlier member
            same = sets.label[first[node]]
            low, high = self._span(depth, sets.label)
            near &= ~((low[node] == high[node]) & (same == sets.label[q]))
            q, node, acc = q[near], node[near], acc[near]
            if not len(q):
                return
            whole = acc + np.bitwise_count(~mask[node]) <= limit
            if whole.any():
                sets.merge(q[whole], first[node[whole]])
                sets.merge(q[whole], last[node[whole]])
                q, node, acc = q[~whole], node[~whole], acc[~whole]
            if depth == 0 or not len(q):
                return
            held = mask[node]
            n = child_end[node] - child[node] + 1
            ends = np.cumsum(n)
            step = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
            q, acc, held, node = np.repeat(q, n), np.repeat(acc, n), np.repeat(held, n), np.repeat(child[node], n) + step

    def _span(self, depth: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.levels[depth][2]
        return np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)


def _spanning_links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (g1, g2, fp) sorted by group: spanning links of each group; a group is never cut."""

    def solve(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        g1, g2, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        group = np.cumsum(np.concatenate(([0], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]))))
        index = GrayIndex(group, fp.view(np.uint64))
        label = index.links(limit)
        own = fp[index.order]
        linked = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[label[linked]])], names=["src", "dst"])

    held: list = []
    rows = 0
    for batch in batches:
        g1, g2, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(g1):
            continue
        if rows > 200_000:
            same = (g1 == held[-1][0][-1]) & (g2 == held[-1][1][-1])
            cut = len(g1) if same.all() else int(np.argmin(same))
            if cut < len(g1):
                yield solve([*held, (g1[:cut], g2[:cut], fp[:cut])])
                held, rows, g1, g2, fp = [], 0, g1[cut:], g2[cut:], fp[cut:]
        held.append((g1, g2, fp))
        rows += len(g1)
    if held:
        yield solve(held)


def _pairs_of_blocks(code: str, width: int, base: int, tag: int) -> F.Column:
    """Keys of the six ways in which two of four ``width``-bit blocks, from bit ``base`` up, can agree."""
    block = lambda i: f"(shiftrightunsigned({code}, {base + i * width}) & {2**width - 1})"
    return [F.expr(f"{tag * 8 + k} * {2 ** (2 * width)}L + {block(i)} * {2**width}L + {block(j)}") for k, (i, j) in enumerate(combinations(range(4), 2))]


def near_links(prints: DataFrame, limit: int = LIMIT, split: int = SPLIT) -> DataFrame:
    """Spanning links (src, dst) between the distinct codes of column ``fp`` that differ in at most 2 bits."""
    if limit > 2:
        raise ValueError("blocks are laid out for at most two differing bits")
    dealt = prints.select("fp", F.explode(F.array(*_pairs_of_blocks("fp", 16, 0, 0))).alias("g1"))
    sizes = dealt.groupBy("g1").count().where("count > 1")
    near = dealt.join(sizes, "g1")
    small = near.where(F.col("count") <= split).select("g1", F.lit(0).cast("long").alias("g2"), "fp")
    # the 32 bits outside the two shared blocks, laid side by side
    rest = F.element_at(F.array(*[F.expr(f"(shiftrightunsigned(fp, {16 * b}) & 65535) * 65536L + (shiftrightunsigned(fp, {16 * a}) & 65535)") for a, b in (tuple(sorted({0, 1, 2, 3} - {i, j})) for i, j in combinations(range(4), 2))]), (F.shiftrightunsigned("g1", 32) + 1).cast("int"))
    hot = near.where(F.col("count") > split).withColumn("rest", rest)
    hot = hot.select("g1", F.explode(F.array(*_pairs_of_blocks("rest", 8, 0, 1))).alias("g2"), "fp")
    groups = small.unionByName(hot).repartition(F.col("g1"), F.col("g2")).sortWithinPartitions("g1", "g2")
    return groups.mapInArrow(partial(_spanning_links, limit=limit), "src long, dst long").distinct()


def fingerprints(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of (id, text) rows."""
    return texts.mapInArrow(partial(_fingerprints, shingle=shingle), "id long, fp long")


def linked(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(fp, root) of the distinct codes of column ``fp``: the smallest code reachable over links."""
    nodes = stored(prints.select("fp").distinct())
    labels = connected_components(near_links(nodes, limit))
    return nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """(id, fp, component): fingerprint as a signed long, smallest id reachable over links."""
    prints = stored(fingerprints(text_frame(docs, id_col, text_col), shingle))
    known = prints.groupBy("fp").agg(F.min("id").alias("least")).join(linked(prints, limit), "fp")
    roots = known.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(known.select("fp", "root").join(roots, "root").select("fp", "component"), "fp")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
