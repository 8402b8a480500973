"""Components: tasks contract what they hold, and a small rest needs no rounds."""

import random

import pytest

from clusterloom.operators import components


def drawn(seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(120) if i % 40 != 39] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(110)]
    pairs += [(500, 500), (501, 501), (501, 502), (3, 3), (None, 7), (600, None)]
    rng.shuffle(pairs)
    return pairs


def plain(pairs):
    label = {v: v for p in pairs if None not in p for v in p}
    for a, b in pairs:
        if a is not None and b is not None:
            x, y = label[a], label[b]
            label = {v: min(x, y) if r in (x, y) else r for v, r in label.items()}
    return label


@pytest.mark.parametrize("held", [5, 60, 2_000_000])
def test_components_are_those_of_plain_merging(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD", held)
    pairs = drawn(held)
    got = components.connected_components(spark.createDataFrame(pairs, "src int, dst long").repartition(5))
    assert got.count() == len(plain(pairs)) and {r["node"]: r["component"] for r in got.collect()} == plain(pairs)
    names = [tuple(None if v is None else f"n{v:03}" for v in p) for p in pairs]
    got = components.connected_components(spark.createDataFrame(names, "src string, dst string").repartition(3))
    assert {r["node"]: r["component"] for r in got.collect()} == plain(names)


def test_few_edges_go_without_rounds(spark, monkeypatch):
    """Rounds of shuffles over a few thousand links left the pipeline's driver tens of thousands of task records."""
    monkeypatch.setattr(components, "_stars", lambda *_: pytest.fail("a round of stars for a few edges"))
    got = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(3000)], "src long, dst long").repartition(8))
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 3001
