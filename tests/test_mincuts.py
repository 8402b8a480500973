"""All minimum cuts against every subset, and the cut that CM and WCC take."""

import itertools
import random

from clusterloom.operators import mincuts, refine


def links_of(n, edges):
    links = [{} for _ in range(n)]
    for a, b, w in edges:
        links[a][b] = links[b][a] = links[a].get(b, 0.0) + w
    return links


def every_minimum(links):
    """The least cut and all sides of it that hold node 0."""
    n, best, sides = len(links), float("inf"), set()
    for k in range(n - 1):
        for some in itertools.combinations(range(1, n), k):
            s = {0, *some}
            w = sum(x for i in s for v, x in links[i].items() if v not in s)
            if w < best - 1e-9:
                best, sides = w, set()
            if abs(w - best) < 1e-9:
                sides.add(frozenset(s))
    return best, sides


def graphs():
    rng = random.Random(11)
    yield links_of(8, [(i, (i + 1) % 8, 1.0) for i in range(8)])
    yield links_of(7, [(0, i, 1.0) for i in range(1, 7)])
    yield links_of(9, [(i, i + 1, 1.0) for i in range(8)])
    for _ in range(250):
        n = rng.randint(3, 10)
        edges = {(rng.randrange(i), i) for i in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 2 * n))}
        heavy = rng.random() < 0.3
        yield links_of(n, [(a, b, float(rng.randint(1, 3)) if heavy else 1.0) for a, b in sorted(edges)])


def test_all_minimum_cuts_once():
    for links in graphs():
        value, sides = every_minimum(links)
        found = [frozenset(i for p in chain[: j + 1] for i in p) for chain in mincuts.minimum_cuts(links, value) for j in range(len(chain))]
        assert len(found) == len(set(found)) and set(found) == sides
        w, members = mincuts.contracted(links, value)
        again = {frozenset(m for p in chain[: j + 1] for i in p for m in members[i]) for chain in mincuts.minimum_cuts(w, value) for j in range(len(chain))}
        assert {s if 0 in s else frozenset(range(len(links))) - s for s in again} == sides


def test_bridges_and_the_most_even_cut():
    for links in graphs():
        n, (value, sides) = len(links), every_minimum(links)
        cut, side = refine.min_cut(links)
        found = frozenset(mincuts.balanced_cut(links, cut, side))
        even = lambda s: min(len(s), n - len(s))  # noqa: E731, B023
        assert abs(cut - value) < 1e-9 and even(found) == max(map(even, sides))
        assert (found if 0 in found else frozenset(range(n)) - found) in sides
        if all(x == 1.0 for near in links for x in near.values()):
            order, places = mincuts.bridges(links)
            ones = {frozenset(range(n)) - set(order[a:b]) for a, b, _ in places}
            assert ones == (sides if value == 1 else set())


def test_long_chain_is_cut_in_the_middle():
    n = 30_000
    links = links_of(n, [(i, i + 1, 1.0) for i in range(n - 1)])
    assert len(mincuts.balanced_cut(links, 1.0, [0])) == n // 2


def test_pieces_of_a_path_are_even():
    path = links_of(12, [(i, i + 1, 1.0) for i in range(11)])
    assert sorted(len(p) for p in refine.well_connected(path, "1log_10(n)", balanced=True)) == [6, 6]
