"""The steps of the block search over arrays, for graphs and block matrices that a task holds.

The states, proposals and acceptances are those of ``blocksearch``.  What moves are units: nodes, or blocks that the joined rounds
have merged, with their inner edges.  A merge is the move of a whole block among the blocks as units, so one formula serves both."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from clusterloom.operators.bins import spans

#: Log-factorials below this are looked up; blocks below this have a full matrix; proposals are rated so many links at a time.
TABLE, FULL, CHUNK = 1 << 16, 1 << 10, 1 << 21
_LOGS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, TABLE)))])


def lf(n: np.ndarray) -> np.ndarray:
    """ln n! of whole numbers."""
    n = np.asarray(n)
    found = _LOGS[np.clip(n, 0, TABLE - 1)]
    large = n >= TABLE
    if large.any():
        x = n[large] + 1.0
        found[large] = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)
    return found


def _inner(m: np.ndarray) -> np.ndarray:
    return lf(m) + m * math.log(2.0)


def _block(model: str, n: np.ndarray, e: np.ndarray) -> np.ndarray:
    """What blocks of n nodes and e ends add; 0 for no nodes."""
    some = np.maximum(n, 1)
    if model == "ndc":
        found = e * np.log(some) - lf(some)
    else:
        found = lf(some + e - 1) - lf(some) - lf(some - 1)
    return np.where(n > 0, found, 0.0)


def _planted(b: int, e: int, inner: np.ndarray) -> np.ndarray:
    """``pp``: what ``inner`` of e edges within b blocks add."""
    out = e - inner
    across = out * math.log(b * (b - 1) / 2) + math.log(e + 1) if b > 1 else 0.0
    return inner * math.log(b / 2) + across - lf(inner) - lf(out)


@dataclass(frozen=True)
class Units:
    """Units of ``size`` nodes, ``ends`` of edges and ``inner`` edges; links (a, b, m), each pair once; the graph's nodes and edges."""

    model: str
    seed: int
    size: np.ndarray
    ends: np.ndarray
    inner: np.ndarray
    a: np.ndarray
    b: np.ndarray
    m: np.ndarray
    n: int
    e: int


def summed(major: np.ndarray, minor: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order and their weights."""
    key = major * width + minor
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight[order], starts) if len(key) else weight
    return key[starts] // width, key[starts] % width, total


class State:
    """Blocks 0 to b - 1 of the units, the links from each unit to each block, the block matrix and the length."""

    def __init__(self, g: Units, label: np.ndarray, prior) -> None:
        names, self.label = np.unique(label, return_inverse=True)
        self.b = b = len(names)
        label = self.label
        self.v, self.u, self.d = summed(np.concatenate([g.a, g.b]), label[np.concatenate([g.b, g.a])], np.concatenate([g.m, g.m]), b)
        self.first = np.searchsorted(self.v, np.arange(len(label) + 1))
        own = np.flatnonzero(g.inner)
        self.r, self.s, self.m = summed(np.concatenate([label[self.v], label[own]]), np.concatenate([self.u, label[own]]), np.concatenate([self.d, 2 * g.inner[own]]), b)
        self.rows = np.searchsorted(self.r, np.arange(b + 1))
        self.key, self.full = self.r * b + self.s, None
        if b <= FULL:
            self.full = np.zeros(b * b, np.int64)
            self.full[self.key] = self.m
        self.n, self.e = (np.bincount(label, x, b).astype(np.int64) for x in (g.size, g.ends))
        same = self.r == self.s
        self.inner = np.bincount(self.r[same], self.m[same] // 2, b).astype(np.int64)
        self.within = int(self.inner.sum())
        cells = -_inner(self.inner).sum() - lf(self.m[~same]).sum() / 2 if g.model != "pp" else float(_planted(b, g.e, np.array([self.within]))[0])
        self.length = float(_block(g.model, self.n, self.e).sum() + cells + prior(g.model, b, g.n, g.e))

    def cell(self, r: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Entries of the matrix."""
        key = r * self.b + u
        if self.full is not None:
            return self.full[key]
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return np.where(self.key[at] == key, self.m[at], 0) if len(self.key) else np.zeros(len(key), np.int64)


def changes(g: Units, s: State, v: np.ndarray, t: np.ndarray, prior) -> np.ndarray:
    """What each move of a unit to another block adds to the length, by itself."""
    each = s.first[v + 1] - s.first[v]
    cuts = np.searchsorted(np.cumsum(each), np.arange(CHUNK, each.sum() + CHUNK, CHUNK), side="right")
    ends = np.unique(np.concatenate([[0], cuts, [len(v)]]))
    return np.concatenate([_changes(g, s, v[i:j], t[i:j], prior) for i, j in zip(ends[:-1], ends[1:], strict=True)] or [np.zeros(0)])


def _changes(g: Units, s: State, v: np.ndarray, t: np.ndarray, prior) -> np.ndarray:
    r, places = s.label[v], spans(s.first, v)
    which = np.repeat(np.arange(len(v)), s.first[v + 1] - s.first[v])
    u, d = s.u[places], s.d[places]
    to_r, to_t = u == r[which], u == t[which]
    d_r, d_t = (np.bincount(which[x], d[x], len(v)).astype(np.int64) for x in (to_r, to_t))
    n_r, e_r, n_t, e_t = s.n[r], s.e[r], s.n[t], s.e[t]
    n, k, w = g.size[v], g.ends[v], g.inner[v]
    found = _block(g.model, n_r - n, e_r - k) - _block(g.model, n_r, e_r) + _block(g.model, n_t + n, e_t + k) - _block(g.model, n_t, e_t)
    last = n_r == n
    found += np.where(last, prior(g.model, s.b - 1, g.n, g.e) - prior(g.model, s.b, g.n, g.e), 0.0)
    if g.model == "pp":
        inner = s.within + d_t - d_r
        found += np.where(last, _planted(max(1, s.b - 1), g.e, inner), _planted(s.b, g.e, inner)) - _planted(s.b, g.e, np.array([s.within]))
    else:
        other = ~(to_r | to_t)
        which, u, d = which[other], u[other], d[other]
        m_ru, m_tu = s.cell(r[which], u), s.cell(t[which], u)
        found -= np.bincount(which, lf(m_ru - d) - lf(m_ru) + lf(m_tu + d) - lf(m_tu), len(v))
        m_rt, in_r, in_t = s.cell(r, t), s.inner[r], s.inner[t]
        found += _inner(in_r) - _inner(in_r - d_r - w) + _inner(in_t) - _inner(in_t + d_t + w) + lf(m_rt) - lf(m_rt + d_r - d_t)
    return found


def _drawn(rng: np.random.Generator, first: np.ndarray, to: np.ndarray, weight: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key one of its rows' ``to``, by weight; -1 for a key without rows."""
    ahead = np.concatenate([[0], np.cumsum(weight)])
    low, high = ahead[first[keys]], ahead[first[keys + 1]]
    at = np.searchsorted(ahead, low + np.floor(rng.random(len(keys)) * (high - low)), side="right") - 1
    return np.where(high > low, to[np.minimum(at, max(0, len(to) - 1))] if len(to) else -1, -1)


def proposed(rng: np.random.Generator, s: State, draws: int, direct: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (unit, other block): along the matrix, to neighbouring blocks, and to any block."""
    every = np.arange(len(s.label))
    v, t = [every], [rng.integers(s.b, size=len(every))]
    for k in range(draws):
        u = _drawn(rng, s.first, s.u, s.d, every)
        some = u >= 0
        v.append(every[some])
        t.append(_drawn(rng, s.rows, s.s, s.m, u[some]))
        if k < direct:
            v.append(every[some])
            t.append(u[some])
    v, t = np.concatenate(v), np.concatenate(t)
    apart = (t >= 0) & (t != s.label[v])
    key = np.unique(v[apart] * s.b + t[apart])
    return key // s.b, key % s.b


def best_of(key: np.ndarray, change: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, to, change) of the least change of each key, the smaller ``to`` on a tie."""
    order = np.lexsort((to, change, key))
    key, change, to = key[order], change[order], to[order]
    one = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return key[one], to[one], change[one]


class Search:
    """Moves and merges of ``blocksearch`` over the units ``g``; ``prior`` is its prior of the number of blocks."""

    def __init__(self, prior, node_draws: int, block_draws: int, direct: int) -> None:
        self.prior, self.node_draws, self.block_draws, self.direct = prior, node_draws, block_draws, direct

    def state(self, g: Units, label: np.ndarray) -> State:
        return State(g, label, self.prior)

    def moved(self, g: Units, s: State, round_: int) -> State | None:
        if s.b < 2:
            return None
        rng = np.random.default_rng((g.seed, round_, 0))
        v, t = proposed(rng, s, self.node_draws, self.direct)
        change = changes(g, s, v, t, self.prior)
        shorter = change < -1e-9
        v, t, change = best_of(v[shorter], change[shorter], t[shorter])
        if not len(v):
            return None
        turn, part, best = rng.random(len(v)), 0.5, np.lexsort((v, change))[:1]
        while True:
            some = np.flatnonzero(turn < part) if part * len(v) >= 2 else best
            label = s.label.copy()
            label[v[some]] = t[some]
            found = self.state(g, label)
            if found.length < s.length - 1e-9:
                return found
            if some is best:
                return None
            part /= 4

    def merged(self, g: Units, s: State, round_: int, shorter: bool = False) -> State | None:
        if s.b < 2:
            return None
        rng = np.random.default_rng((g.seed, round_, 1))
        apart = s.r < s.s
        whole = Units(g.model, g.seed, s.n, s.e, s.inner, s.r[apart], s.s[apart], s.m[apart], g.n, g.e)
        blocks = self.state(whole, np.arange(s.b))
        waits = rng.random(s.b) < 0.5
        r, t = proposed(rng, blocks, self.block_draws, self.direct)
        asks = ~waits[r] & waits[t]
        r, t = r[asks], t[asks]
        change = changes(whole, blocks, r, t, self.prior)
        if shorter:
            r, t, change = (x[change < -1e-9] for x in (r, t, change))
        r, t, change = best_of(r, change, t)
        ways = [(r, t)]
        if shorter:
            wait, asker, _ = best_of(t, change, r)
            least = np.lexsort((r, change))[:1]
            ways += [(asker, wait), (r[least], t[least])]
        for block, to in ways:
            if not len(block):
                return None
            at = np.arange(s.b)
            at[block] = to
            found = self.state(g, at[s.label])
            if not shorter or found.length < s.length - 1e-9:
                return found
        return None
