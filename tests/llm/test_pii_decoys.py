"""Precision of the added secrets and names beside things that look alike."""

import uuid

import numpy as np
import pytest

from clusterloom.llm import pii

WORDS = "the quick brown fox jumps over lazy dogs and returns".split()


@pytest.fixture(scope="module")
def found(spark):
    rng = np.random.default_rng(21)
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    letters = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    makers = {
        "secret": lambda: str(rng.choice([f'token = "{hexes(40)}"', f"password: {letters(11)}!7a", f"AKIA{hexes(16).upper()}", f"api_key={letters(32)}", f"the key {hexes(64)}"])),
        "commit": lambda: f"commit {hexes(40)}",
        "sha1": lambda: f"sha1 {hexes(40)}",
        "md5": lambda: f"md5: {hexes(32)}",
        "sha256": lambda: f"sha256 checksum {hexes(64)}",
        "bare": lambda: hexes(40),
        "etag": lambda: f'etag "{hexes(32)}"',
        "revision": lambda: f"revision {hexes(40)}",
        "uuid": lambda: str(uuid.UUID(hexes(32))),
        "url": lambda: f"https://example.org/{'/'.join(rng.choice(WORDS, 3))}/{letters(24)}1a",
        "path": lambda: f"Long_Module_Name_{rng.integers(1, 9)}_for_tests/and_more{rng.integers(1, 9)}",
        "place": lambda: str(rng.choice(["Charlotte Airport", "Martin Luther avenue", "Victor Street", "Maria Hospital", "Karl Marx Platz"])),
        "person": lambda: str(rng.choice(["Mr. Thomas Weber", "Dear Laura Schmidt"])),
    }
    rows, kinds = [], []
    for kind, make in makers.items():
        for _ in range(100):
            rows.append(" ".join([*rng.choice(WORDS, 12), make(), *rng.choice(WORDS, 12)]))
            kinds.append(kind)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["id"]: r for r in pii.personal_data(docs).collect()}
    return lambda kind, column: sum(got[i][column] > 0 for i, k in enumerate(kinds) if k == kind)


@pytest.mark.parametrize("kind", ["commit", "sha1", "md5", "sha256", "bare", "etag", "revision", "uuid", "url", "path"])
def test_what_looks_like_a_key_is_left_alone(found, kind):
    assert found(kind, "added_secret") <= 5


def test_places_are_no_people(found):
    assert found("place", "added_name") <= 5


def test_secrets_and_people_beside_them_are_found(found):
    assert found("secret", "added_secret") >= 90 and found("person", "added_name") >= 90
