"""Removal of long repeated byte strings through common-prefix interval trees of sparse suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere.  Suffixes are sampled by
content: of all ``GRAM``-byte grams in a window of ``LENGTH`` bytes the one with the least hash is an
anchor, so equal windows have equal anchors at equal offsets and no repeat is missed.

1.  Tasks count contexts (an anchor with up to ``SIDE`` bytes on both sides, told apart by a BLAKE2 digest of
    the bytes), first within the task, then over the corpus by (gram, context).  Equal contexts are one
    suffix with a multiplicity: one that occurs twice is an interval by itself and repeats whole.
2.  How many contexts a gram has is summed from those partial counts.  Where it has several, one copy of each is
    sent to the gram's task.  There they
    form an enhanced suffix array: sorted by what follows, with common prefix lengths.  A stack scan
    closes its intervals from deep to shallow; each holds all its occurrences, ordered by what
    precedes them, and joining two intervals compares each occurrence of the smaller one with its
    neighbours in that order.  That tests how far occurrences extend to the left where they differ, which
    is what makes a repeat maximal, and finds for every occurrence its longest match on either side.
    ``maximal_groups`` lists the groups themselves, each with all its occurrences.
3.  The contexts of a gram with more than ``HOT`` of them are never in one task: the digests of the windows around
    them are counted instead, which is the same tree cut at depth ``LENGTH`` and splits by window.
4.  Documents cut out the union of what their anchors found.

The gram's 64-bit hash only brings occurrences together: trees compare the bytes from the gram on, and
what counts as equal without a tree is equal by a cryptographic digest of 128 bits.
Documents meet their findings by hash part, so a passage in very many documents costs one entry for
each part and task, not for each document.  Long texts are worked on in pieces of ``CHUNK`` bytes.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes keep everything; repeated rows and repeats
within one document count as elsewhere; an empty table gives an empty result.  Extra columns are
never read.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm.common import raw
from clusterloom.sources.storage import stored

LENGTH = 200
GRAM = 64
SIDE = LENGTH - GRAM
HOT = 4096
PART_BYTES = 16 << 20
LEAST_PART_BYTES = 2 << 20  # where the cluster has cores for more parts
CHUNK = 1 << 20
FULL, SHIP, WINDOWS = 1, 2, 4

_U = np.uint64
_TABLE = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_PLACES = _U((1 << 24) - 1)  # more than a chunk holds
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(max(n, CHUNK + LENGTH), base, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, _U)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Anchors of some pieces of texts laid side by side: place, piece and gram hash.

    A piece is (text number, offset in the text, bytes, first and last place that it owns); it holds what
    stands around the anchors it owns, so its ends cut a context only where the text ends too.
    """

    def __init__(self, pieces: list[tuple[int, int, bytes, int, int]]):
        self.data = b"".join(p[2] for p in pieces)
        a = np.frombuffer(self.data, np.uint8)
        n = len(a)
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.of = np.array([p[0] for p in pieces], np.int64)  # the text of each piece
        self.shift = np.array([p[1] for p in pieces], np.int64) - self.begins  # from places here to places in the text
        self.at = self.low = self.high = np.zeros(0, np.int64)
        self.sums = np.zeros(n + 1, _U)
        power, self.inverse = _power(n + 1)
        np.cumsum(_TABLE[a] * power[:n], out=self.sums[1:])
        if n >= LENGTH:
            grams = _mix(self._span_hash(np.arange(n - GRAM + 1), GRAM))
            # The low bits give way to the place, always as many: equal windows choose alike whatever surrounds them.
            least = _sliding_min((grams & ~_PLACES) | np.arange(len(grams), dtype=_U), LENGTH - GRAM + 1)
            inside = np.zeros(n + 1, np.int64)  # windows that no end of a piece cuts
            long = sizes >= LENGTH
            np.add.at(inside, self.begins[long], 1)
            np.add.at(inside, self.ends[long] - LENGTH + 1, -1)
            valid = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
            chosen = least[valid] & _PLACES
            if len(chosen):
                keep = np.concatenate(([True], chosen[1:] != chosen[:-1]))
                # A window belongs to the anchor that it chooses; those of one anchor are neighbours.
                self.at, self.low = chosen[keep].astype(np.int64), valid[keep]
                self.high = valid[np.append(np.flatnonzero(keep)[1:], len(chosen)) - 1]
        self.piece = np.searchsorted(self.ends, self.at, side="right")
        if len(self.at):
            place = self.at + self.shift[self.piece]
            own = (place >= np.array([p[3] for p in pieces])[self.piece]) & (place < np.array([p[4] for p in pieces])[self.piece])
            self.at, self.piece, self.low, self.high = self.at[own], self.piece[own], self.low[own], self.high[own]
        self.left = np.maximum(self.begins[self.piece], self.at - SIDE) if len(self.at) else self.at
        self.right = np.minimum(self.ends[self.piece], self.at + GRAM + SIDE) if len(self.at) else self.at
        self.gram = _mix(self._span_hash(self.at, GRAM))

    def _span_hash(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.inverse[at]

    def contexts(self, which: np.ndarray) -> list[bytes]:
        """A digest of each given anchor's context: its bytes, and how many stand before the gram."""
        data, digest = self.data, hashlib.blake2b
        rows = zip(self.left[which].tolist(), self.at[which].tolist(), self.right[which].tolist(), strict=True)
        return [digest(data[x:z], digest_size=16, salt=bytes((y - x,))).digest() for x, y, z in rows]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Starts and digests of the windows that chose the given anchors."""
        n = self.high[which] - self.low[which] + 1
        ends = np.cumsum(n)
        at = np.repeat(self.low[which] - ends + n, n) + np.arange(int(n.sum()))
        return at, [hashlib.blake2b(self.data[x : x + LENGTH], digest_size=16).digest() for x in at.tolist()]

    def text_place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and place in it of places here."""
        piece = np.searchsorted(self.ends, at, side="right")
        return self.of[piece], at + self.shift[piece]


def _pieces(texts: list[bytes], size: int) -> Iterator[tuple[int, int, bytes, int, int]]:
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if len(t) <= size:
            yield i, 0, t, 0, len(t)
            continue
        for at in range(0, len(t), size):
            first = max(0, at - SIDE)
            yield i, first, t[first : at + size + LENGTH], at, at + size


def _chunks(texts: list[bytes]) -> Iterator[Anchors]:
    size = CHUNK
    held: list[tuple[int, int, bytes, int, int]] = []
    total = 0
    for piece in _pieces(texts, size):
        if held and total + len(piece[2]) > size + 2 * LENGTH:
            yield Anchors(held)
            held, total = [], 0
        held.append(piece)
        total += len(piece[2])
    if held:
        yield Anchors(held)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0].astype(_U), both[:, 1].astype(_U)


def _whole(first: np.ndarray, second: np.ndarray) -> list[bytes]:
    data = np.stack([first, second], 1).astype("<u8").tobytes()
    return [data[i : i + 16] for i in range(0, len(data), 16)]


def _tallied(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the key columns, sorted, and the place of each row among them."""
    order = np.lexsort(keys[::-1])
    cols = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0) if len(order) else False
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return [c[new] for c in cols], place


def _dealt(key: np.ndarray, tasks: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows of the columns by the task of their key, as (task, packed columns)."""
    task = (key % _U(tasks)).astype(np.int64)
    order = np.argsort(task, kind="stable")
    cuts = np.flatnonzero(np.diff(task[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(task[rows[0]]), pickle.dumps([c[rows] for c in columns], 5)


def _table_of(name: str, sent: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({name: pa.array([t for t, _ in sent], pa.int32()), "packed": pa.array([b for _, b in sent], pa.binary())})


def _joined(tables: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*map(pickle.loads, tables), strict=True)]


def _counted(batches: Iterator[pa.RecordBatch], tasks: int) -> Iterator[pa.RecordBatch]:
    """Step 1 in a task: (gram, context, part, times), tallied over as many texts as a batch holds."""
    for batch in batches:
        part_of = batch.column(0).to_numpy()
        found = []
        for a in _chunks(raw(batch.column(1))):
            if len(a.at):
                found.append((a.gram, *_halves(a.contexts(np.arange(len(a.at)))), part_of[a.of[a.piece]].astype(np.int64)))
        if not found:
            continue
        gram, c0, c1, part = (np.concatenate(x) for x in zip(*found, strict=True))
        (gram, c0, c1, part), place = _tallied(gram, c0, c1, part)
        times = np.bincount(place, minlength=len(gram))
        yield from _table_of("salt", list(_dealt(gram ^ c0, tasks, gram, c0, c1, part.astype(np.int32), times.astype(np.int32)))).to_batches()


def gram_counts(gram: np.ndarray, c0: np.ndarray, c1: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, number of contexts, number of occurrences) of what one task holds."""
    (g, _, _), place = _tallied(gram, c0, c1)
    n = np.bincount(place, weights=times, minlength=len(g)).astype(np.int64)
    grams, contexts = np.unique(g, return_counts=True)
    return grams, contexts, np.bincount(np.searchsorted(grams, g), weights=n, minlength=len(grams)).astype(np.int64)


def judge(gram: np.ndarray, c0: np.ndarray, c1: np.ndarray, part: np.ndarray, times: np.ndarray, kinds: dict[int, int]) -> tuple[np.ndarray, ...]:
    """(part, gram, c0, c1, flags) of the contexts of grams that ``kinds`` (gram to flag) knows.

    All of a context's rows are here, from whatever part; the first part ships it.
    """
    (g, x, y, p), place = _tallied(gram, c0, c1, part)
    n = np.bincount(place, weights=times, minlength=len(g)).astype(np.int64)
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    total = np.bincount(np.cumsum(first) - 1, weights=n).astype(np.int64)[np.cumsum(first) - 1] if len(g) else n
    kind = np.fromiter(map(kinds.get, g.tolist(), [-1] * len(g)), np.int64, len(g))
    flags = np.where(total >= 2, FULL, 0) | np.where(first & (kind > 0), kind, 0)
    keep = (kind >= 0) & (flags > 0)
    return p[keep], g[keep], x[keep], y[keep], flags[keep].astype(np.int8)


def _flags(judged: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """Ascending grams that matter to a part, and the flags of its contexts."""
    gram, c0, c1, flags = _joined(judged)
    return np.unique(gram), dict(zip(_whole(c0, c1), flags.tolist(), strict=True))


def _known(a: Anchors, grams: np.ndarray, flags: dict[bytes, int]) -> Iterator[tuple[int, bytes, int]]:
    """(anchor, context, flags) of the anchors that have flags."""
    at = np.searchsorted(grams, a.gram)
    some = np.flatnonzero(grams[np.minimum(at, len(grams) - 1)] == a.gram)
    for i, c in zip(some.tolist(), a.contexts(some), strict=True):
        if flag := flags.get(c):
            yield i, c, flag


def _contexts(texts: list[bytes], part: int, judged: list[bytes], tasks: int) -> Iterator[tuple[int, int, bytes]]:
    """Steps 2 and 3 in a part: (kind, task, packed) for contexts to ship and windows to count."""
    grams, flags = _flags(judged)
    groups: dict[int, list] = {}
    done: set[bytes] = set()
    keys: dict[bytes, int] = {}
    for a in _chunks(texts):
        hot = []
        for i, c, flag in _known(a, grams, flags):
            if flag & SHIP and c not in done:
                done.add(c)
                gram, at = int(a.gram[i]), int(a.at[i])
                row = (gram, a.data[at : int(a.right[i])], a.data[int(a.left[i]) : at][::-1], c, bool(flag & FULL), part)
                groups.setdefault(gram % tasks, []).append(row)
            if flag & WINDOWS and c not in done:  # one copy counts; where there are more, all of it repeats anyway
                done.add(c)
                hot.append(i)
        if hot:
            for w in a.windows(np.array(hot))[1]:
                keys[w] = keys.get(w, 0) + 1
    for task, rows in groups.items():
        yield 0, task, pickle.dumps(rows, 5)
    if keys:
        w0, w1 = _halves(list(keys))
        for task, packed in _dealt(w0, tasks, w0, w1, np.fromiter(keys.values(), np.int64), np.full(len(keys), part)):
            yield 1, task, packed


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def longest_matches(before: list[bytes], after: list[bytes]) -> list[tuple[int, int]]:
    """For each occurrence of one gram the farthest (left, right) that some match of ``LENGTH`` reaches.

    ``before`` is reversed, ``after`` begins with the gram.  (0, 0) stays where no other occurrence
    matches long enough; occurrences of another gram of the same hash never do.
    """
    n = len(after)
    order = sorted(range(n), key=lambda i: (after[i], before[i]))  # the suffix array
    prefix = [-1, *(_common(after[a], after[b]) for a, b in zip(order, order[1:], strict=False))]
    by_left = sorted(range(n), key=lambda i: before[i])
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    best = [(0, 0)] * n

    def meet(i: int, j: int, depth: int) -> None:
        left = _common(before[i], before[j])
        if left + depth >= LENGTH:
            best[i] = (max(best[i][0], left), max(best[i][1], depth))
            best[j] = (max(best[j][0], left), max(best[j][1], depth))

    def join(a: list[int], b: list[int], depth: int) -> list[int]:
        """All occurrences of both intervals, by what precedes them."""
        if len(a) < len(b):
            a, b = b, a
        for r in b:
            k = bisect_left(a, r)
            if k:
                meet(by_left[a[k - 1]], by_left[r], depth)
            if k < len(a):
                meet(by_left[r], by_left[a[k]], depth)
        a += b
        a.sort()
        return a

    stack: list[tuple[int, list[int]]] = []  # (common prefix with the interval to the left, occurrences)
    for i, depth in zip([*order, None], [*prefix, -1], strict=True):
        while len(stack) > 1 and stack[-1][0] > depth:
            d, top = stack.pop()
            stack[-1] = (stack[-1][0], join(stack[-1][1], top, d))
        if i is not None:
            stack.append((depth, [rank[i]]))
    return best


def maximal_groups(before: list[bytes], after: list[bytes], least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of ``least`` bytes or more around one gram: (left, right, all occurrences).

    Every interval of the suffix array (occurrences that agree on ``right`` bytes from the gram on, some of which
    differ behind) is ordered by what precedes; runs that agree on enough bytes are groups where
    their left extensions differ, and shrink to the longer-agreeing runs inside.  The output is as
    large as the groups are in sum.
    """
    order = sorted(range(len(after)), key=lambda i: (after[i], before[i]))
    prefix = [-1, *(_common(after[a], after[b]) for a, b in zip(order, order[1:], strict=False)), -1]

    def runs(members: list[int], depth: int, child: dict[int, int]) -> Iterator[tuple[int, int, list[int]]]:
        members = sorted(members, key=lambda i: before[i])
        near = [_common(before[a], before[b]) for a, b in zip(members, members[1:], strict=False)]
        todo = [(0, len(members) - 1)]
        while todo:
            lo, hi = todo.pop()
            if lo >= hi:
                continue
            left = min(near[lo:hi])
            if left + depth >= least and len({child[i] for i in members[lo : hi + 1]}) > 1:
                yield left, depth, members[lo : hi + 1]
            cuts = [k for k in range(lo, hi) if near[k] == left]
            todo += list(zip([lo, *(k + 1 for k in cuts)], [*cuts, hi], strict=True))

    open_: list[tuple[int, int]] = []  # (depth, first place) of the intervals that are not closed yet
    for place in range(1, len(order) + 1):
        first, depth = place - 1, prefix[place]
        while open_ and open_[-1][0] > depth:
            d, first = open_.pop()
            child, number = {}, 0
            for k in range(first, place):
                number += k > first and prefix[k] == d
                child[order[k]] = number
            for i in range(first, place):  # suffixes that end here are children of their own
                if len(after[order[i]]) == d:
                    child[order[i]] = -1 - i
            yield from runs(order[first:place], d, child)
        if depth >= 0 and (not open_ or open_[-1][0] < depth):
            open_.append((depth, first))


def _solved(kinds: list[int], packed: list[bytes]) -> list[tuple[int, bytes]]:
    """Steps 2 and 3 in a gram's task: findings by part, packed as (kind, findings)."""
    rows = sorted(r for k, p in zip(kinds, packed, strict=True) if k == 0 for r in pickle.loads(p))
    out: dict[int, list] = {}
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        if j - i > 1:
            for row, (left, right) in zip(rows[i:j], longest_matches([r[2] for r in rows[i:j]], [r[1] for r in rows[i:j]]), strict=True):
                if right and not row[4]:
                    out.setdefault(row[5], []).append((row[3], left, right))
        i = j
    sent = [(p, pickle.dumps((0, found), 5)) for p, found in sorted(out.items())]
    if counted := [p for k, p in zip(kinds, packed, strict=True) if k == 1]:
        w0, w1, times, part = _joined(counted)
        (x, y), place = _tallied(w0, w1)
        keep = np.bincount(place, weights=times)[place] >= 2
        for p in np.unique(part[keep]):
            own = keep & (part == p)
            sent.append((int(p), pickle.dumps((1, _whole(w0[own], w1[own])), 5)))
    return sent


def _spans(texts: list[bytes], judged: list[bytes], solved: list[bytes]) -> list[list[tuple[int, int]]]:
    """Step 4: the merged spans of each text."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not judged:
        return spans
    grams, flags = _flags(judged)
    findings = [pickle.loads(s) for s in solved]
    reach = {c: (left, right) for kind, f in findings if kind == 0 for c, left, right in f}
    keys = {w for kind, f in findings if kind == 1 for w in f}
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in _chunks(texts):
        pairs, hot = [], []
        for i, c, flag in _known(a, grams, flags):
            if flag & FULL:
                pairs.append((int(a.left[i]), int(a.right[i])))
            elif c in reach:
                at, (left, right) = int(a.at[i]), reach[c]
                pairs.append((at - left, at + right))
            if flag & WINDOWS:
                hot.append(i)
        if hot and keys:
            pairs += [(x, x + LENGTH) for x, w in zip(*a.windows(np.array(hot)), strict=True) if w in keys]
        if pairs:
            start, end = np.array(pairs, np.int64).T
            text, place = a.text_place(start)
            found.append((text, place, place + end - start))
    if not found:
        return spans
    text, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    apart = text << 40  # texts one after another on one line
    end = np.maximum.accumulate(end + apart)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start + apart)[1:] > end[:-1]
    fresh[1:] |= text[1:] != text[:-1]
    last = np.append(np.flatnonzero(fresh)[1:], len(start)) - 1
    for t, x, y in zip(text[fresh].tolist(), start[fresh].tolist(), (end - apart)[last].tolist(), strict=True):
        spans[t].append((x, y))
    return spans


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, spans, kept_sha256): spans to remove, in bytes, and the hash of what is left."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // PART_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-size // LEAST_PART_BYTES)), 1)
    rows = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int").alias("part"), "id", "text")
    counted = rows.select("part", "text").mapInArrow(partial(_counted, tasks=parts), "salt int, packed binary")

    def grams_of(table: pa.Table) -> pa.Table:
        gram, c0, c1, _, times = _joined(table.column("packed").to_pylist())
        gram, contexts, total = gram_counts(gram, c0, c1, times)
        return _table_of("task", list(_dealt(gram, parts, gram, contexts, total, np.full(len(gram), table.column("salt")[0].as_py()))))

    def kinds_of(table: pa.Table) -> pa.Table:
        gram, contexts, total, salt = _joined(table.column("packed").to_pylist())
        every, place = np.unique(gram, return_inverse=True)
        contexts = np.bincount(place, weights=contexts, minlength=len(every))
        kind = np.where(contexts < 2, 0, np.where(contexts > hot, WINDOWS, SHIP))[place]
        keep = np.bincount(place, weights=total, minlength=len(every))[place] >= 2
        return _table_of("salt", list(_dealt(salt[keep].astype(np.uint64), parts, gram[keep], kind[keep])))

    def judged_of(counts: pa.Table, kinds: pa.Table) -> pa.Table:
        if not counts.num_rows or not kinds.num_rows:
            return _table_of("part", [])
        gram, kind = _joined(kinds.column("packed").to_pylist())
        part, *columns = judge(*_joined(counts.column("packed").to_pylist()), dict(zip(gram.tolist(), kind.tolist(), strict=True)))
        return _table_of("part", list(_dealt(part.astype(np.uint64), parts, *columns)))

    by_salt = counted.groupBy("salt")
    kinds = by_salt.applyInArrow(grams_of, "task int, packed binary").groupBy("task").applyInArrow(kinds_of, "salt int, packed binary")
    judged = stored(by_salt.cogroup(kinds.groupBy("salt")).applyInArrow(judged_of, "part int, packed binary"))

    def contexts_of(texts: pa.Table, found: pa.Table) -> pa.Table:
        sent = []
        if found.num_rows and texts.num_rows:
            sent = list(_contexts(raw(texts.column("text")), texts.column("part")[0].as_py(), found.column("packed").to_pylist(), parts))
        return pa.table({"kind": pa.array([k for k, _, _ in sent], pa.int32()), "task": pa.array([t for _, t, _ in sent], pa.int32()), "packed": pa.array([p for _, _, p in sent], pa.binary())})

    def solved_of(table: pa.Table) -> pa.Table:
        return _table_of("part", _solved(table.column("kind").to_pylist(), table.column("packed").to_pylist()))

    def cut_of(texts: pa.Table, found: pa.Table) -> pa.Table:
        kinds, packed = found.column("kind").to_pylist(), found.column("packed").to_pylist()
        data = raw(texts.column("text"))
        spans = _spans(data, *([p for k, p in zip(kinds, packed, strict=True) if k == want] for want in (0, 1)))
        shas = []
        for t, s in zip(data, spans, strict=True):
            left, last = hashlib.sha256(), 0
            for x, y in s:
                left.update(t[last:x])
                last = y
            left.update(t[last:])
            shas.append(left.hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": texts.column("id"), "n_bytes": pa.array([len(t) for t in data], pa.int64()), "spans": pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], kind), "kept_sha256": pa.array(shas, pa.string())})

    contexts = rows.groupBy("part").cogroup(judged.groupBy("part")).applyInArrow(contexts_of, "kind int, task int, packed binary")
    solved = stored(contexts.groupBy("task").applyInArrow(solved_of, "part int, packed binary"))
    found = judged.withColumn("kind", F.lit(0)).unionByName(solved.withColumn("kind", F.lit(1)))
    return rows.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(cut_of, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def op2_suffix_interval_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
