"""All minimum cuts of a cluster, and the most balanced of them."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

Links = list[dict[int, float]]
_EPS = 1e-9


def _scan(w: Links) -> list[tuple[float, int, int]]:
    """(bound, i, v) of every edge: what no cut between its ends can be below, by a maximum-adjacency scan."""
    key, done, bounds = [0.0] * len(w), [False] * len(w), []
    heap = [(0.0, i) for i in range(len(w))]
    while heap:
        x, i = heapq.heappop(heap)
        if done[i] or -x != key[i]:
            continue
        done[i] = True
        for v, weight in w[i].items():
            if not done[v]:
                key[v] += weight
                heapq.heappush(heap, (-key[v], v))
                bounds.append((key[v], i, v))
    return bounds


def contracted(links: Links, value: float) -> tuple[Links, list[list[int]]]:
    """The graph with nodes merged that no cut of ``value`` or less parts, as far as scans show it, and who is in each."""
    w, members = [dict(x) for x in links], [[i] for i in range(len(links))]
    while True:
        up = list(range(len(w)))

        def root(i: int, up: list[int] = up) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for bound, i, v in _scan(w):
            if bound > value + _EPS:
                up[root(i)] = root(v)
        place = {r: k for k, r in enumerate(sorted({root(i) for i in range(len(w))}))}
        if len(place) == len(w):
            return w, members
        smaller: Links = [{} for _ in place]
        merged: list[list[int]] = [[] for _ in place]
        for i, near in enumerate(w):
            a = place[root(i)]
            merged[a] += members[i]
            for v, x in near.items():
                if (b := place[root(v)]) != a:
                    smaller[a][b] = smaller[a].get(b, 0.0) + x
        w, members = smaller, merged


def _breadth_first(near: Links, starts: list[int], goal: int | None = None) -> dict[int, int]:
    """The node each reached node was reached from, along arcs with room left."""
    came, queue = dict.fromkeys(starts, -1), deque(starts)
    while queue and goal not in came:
        i = queue.popleft()
        for v, room in near[i].items():
            if room > _EPS and v not in came:
                came[v] = i
                queue.append(v)
    return came


def _strong_parts(near: Links, among: set[int]) -> list[list[int]]:
    """Strongly connected parts of ``among`` by arcs with room left; each comes after all that it leads to."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    parts: list[list[int]] = []
    placed: set[int] = set()
    for start in sorted(among):
        if start in number:
            continue
        walk = [(start, iter(near[start].items()))]
        number[start] = low[start] = len(number)
        stack.append(start)
        while walk:
            i, rest = walk[-1]
            for v, room in rest:
                if room <= _EPS or v not in among or v in placed:
                    continue
                if v not in number:
                    number[v] = low[v] = len(number)
                    stack.append(v)
                    walk.append((v, iter(near[v].items())))
                    break
                low[i] = min(low[i], number[v])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[i])
                if low[i] == number[i]:
                    part = []
                    while not part or part[-1] != i:
                        part.append(stack.pop())
                    placed.update(part)
                    parts.append(part)
    return parts


def minimum_cuts(links: Links, value: float) -> Iterator[list[list[int]]]:
    """Every minimum cut of a connected graph once, ``value`` being its weight: in each list every prefix is one side of a cut.

    Nodes are taken in an order in which each has a link to an earlier one.  The cuts with the first i nodes on one side
    and the next on the other are the sets that no arc with room leaves after a largest flow between them, and
    as the two sides are linked they lie within each other, so strong parts in order list them all."""
    order = list(_breadth_first(links, [0]))
    for i in range(1, len(order)):
        near, flow, goal = [dict(x) for x in links], 0.0, order[i]
        while goal in (came := _breadth_first(near, order[:i], goal)):
            way = [goal]
            while came[way[-1]] != -1:
                way.append(came[way[-1]])
            arcs = list(zip(way[1:], way, strict=False))
            much = min(near[a][b] for a, b in arcs)
            for a, b in arcs:
                near[a][b] -= much
                near[b][a] += much
            flow += much
            if flow > value + _EPS:
                break
        if flow > value + _EPS:
            continue
        behind, queue = {goal}, deque([goal])
        while queue:
            v = queue.popleft()
            for a in near[v]:
                if a not in behind and near[a][v] > _EPS:
                    behind.add(a)
                    queue.append(a)
        yield [sorted(came), *_strong_parts(near, set(range(len(links))) - behind - set(came))]


def bridges(links: Links) -> tuple[list[int], list[tuple[int, int, float]]]:
    """The nodes in the order of a walk through a connected graph, and (from, to, weight) for every edge that alone holds it
    together: those places of the order are one side of it."""
    first, low, order, found = {0: 0}, {0: 0}, [0], []
    walk = [(0, -1, iter(links[0]))]
    while walk:
        i, parent, rest = walk[-1]
        for v in rest:
            if v == parent:
                continue
            if v not in first:
                first[v] = low[v] = len(order)
                order.append(v)
                walk.append((v, i, iter(links[v])))
                break
            low[i] = min(low[i], first[v])
        else:
            walk.pop()
            if walk:
                low[parent] = min(low[parent], low[i])
                if low[i] > first[parent]:
                    found.append((first[i], len(order), links[i][parent]))  # all met since, as the walk has just left it
    return order, found


def balanced_cut(links: Links, value: float, side: list[int]) -> list[int]:
    """One side of the minimum cut with the most nodes on its smaller side; ``value`` and ``side`` are of any minimum cut.

    The first found wins a tie; the order is that of the nodes.  Where no two edges fit in a cut the cuts are the bridges, found in
    linear time.  Else what no such cut parts is contracted; n nodes left take n largest flows of ``value``."""
    n = len(links)
    if n < 4 or value <= _EPS:
        return side
    smaller = lambda k: min(k, n - k)
    best, most = side, smaller(len(side))
    if value < 2 * min(x for near in links for x in near.values()) - _EPS:
        order, sides = bridges(links)
        a, b, _ = max((x for x in sides if x[2] <= value + _EPS), key=lambda x: smaller(x[1] - x[0]))
        return sorted(order[a:b])
    w, members = contracted(links, value)
    for chain in minimum_cuts(w, value):
        k = 0
        for j, part in enumerate(chain):
            k += sum(len(members[i]) for i in part)
            if smaller(k) > most:
                best, most = sorted(m for p in chain[: j + 1] for i in p for m in members[i]), smaller(k)
    return best


def most_even(links: Links, members: list, value: float) -> list[int]:
    """The nodes beside the least member's on the other side of the most even minimum cut, each node counting its ``members``.

    Of several as even the side without the least member is taken that has the least nodes, in order."""
    n = sum(map(len, members))
    best: tuple[int, int, list[int]] | None = None

    def offered(side: list[int], count: int, least: int) -> None:
        nonlocal best
        key = (-min(count, n - count), least)
        if best is None or key < best[:2] or (key == best[:2] and sorted(v for i in side for v in members[i]) < sorted(v for i in best[2] for v in members[i])):
            best = (*key, side)

    if value < 2 * min(x for near in links for x in near.values()) - _EPS:  # no two edges fit in a cut, so the cuts are the bridges
        order, sides = bridges(links)
        counts = [0, *accumulate(len(members[i]) for i in order)]
        most = max(min(counts[b] - counts[a], n - counts[b] + counts[a]) for a, b, x in sides if x <= value + _EPS)
        for a, b, x in sides:
            count = counts[b] - counts[a]
            if x <= value + _EPS and min(count, n - count) == most:
                offered(order[a:b], count, min(int(members[i][0]) for i in order[a:b]))
        return best[2]
    for chain in minimum_cuts(links, value):
        count, least = 0, n
        for j in range(len(chain) - 1, -1, -1):
            count += sum(len(members[i]) for i in chain[j + 1]) if j + 1 < len(chain) else n - sum(len(members[i]) for p in chain for i in p)
            least = min([least, *(int(members[i][0]) for p in chain[j + 1 : j + 2] for i in p)])
            rest = {i for p in chain[: j + 1] for i in p}
            if j + 1 == len(chain):
                least = min(int(members[i][0]) for i in range(len(links)) if i not in rest)
            if best is None or min(count, n - count) >= -best[0]:
                offered([i for i in range(len(links)) if i not in rest], count, least)
    return best[2]
