"""The pipeline's near-duplicate stage against brute force over planted near copies."""

import numpy as np
import pytest

import corpus_pipeline
from clusterloom.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string"


def planted(seed=11):
    """Texts with copies of 1 to 8 words changed, chains of such copies, short texts and unrelated ones."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 300)))) for _ in range(40)]
    for base in range(20):
        last = " ".join(rng.choice(words, int(rng.integers(100, 300))))
        texts.append(last)
        for step in range(6):
            t = (last if base % 2 else texts[-1 - step]).split()
            for _ in range(int(rng.integers(1, 9))):
                t[int(rng.integers(0, len(t)))] = str(rng.choice(words))
            texts.append(" ".join(t))
            last = texts[-1]
    texts += ["a b c", "A  b\tc", "", None, "x " * 60, "x " * 61, texts[50].upper()]
    return list(enumerate(texts))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The smallest id of each row's component over all pairs, and how many pairs are similar."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {rows[i][0]: min(r[0] for r, x in zip(rows, label, strict=True) if x == label[i]) for i in range(len(rows))}, pairs


def test_near_copies_are_those_of_brute_force(spark):
    rows = planted()
    want, pairs = brute(rows)
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA).repartition(3)
    assert pairs > 60 and len(set(want.values())) < len(rows) - 40
    assert {r["id"]: r["component"] for r in nearcopies.near_copy_components(docs).collect()} == want
    kept = corpus_pipeline.thin_out(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def test_one_band_group_is_solved_whole(spark, monkeypatch):
    """All texts in one group of each band: the pairs that the first member does not link are judged too."""
    monkeypatch.setattr(nearcopies, "bands", lambda values: [7] if len(values) else [])
    rows = planted(5)
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA).coalesce(1)
    texts = nearcopies.text_frame(docs, "doc_id", "text")
    sketches = spark.createDataFrame([(i, nearcopies._node(s), len(s), nearcopies.bands(s)) for i, t in rows for s in [nearcopies.shingle_set((t or "").encode())]], "id long, node binary, n long, bands array<long>")
    label = {bytes(r["node"]): r["label"] for r in nearcopies.near_links(sketches, texts).collect()}
    got = {}
    for r in sketches.collect():
        got.setdefault(label[bytes(r["node"])], []).append(r["id"])
    want = {}
    for i, root in brute(rows)[0].items():
        want.setdefault(root, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(want.values())


@pytest.mark.parametrize("n", [8, 40, 600])
def test_bands_meet_at_the_limit(n):
    """Pairs of similarity 0.8 agree on about 41% of the bands, so on one at least."""
    rng = np.random.default_rng(n)
    meet = []
    for _ in range(150):
        x = rng.integers(0, 2**64, n + n // 4, np.uint64)
        meet.append(len(set(nearcopies.bands(x[:n])) & set(nearcopies.bands(x))))
    assert min(meet) > 0 and 0.36 < np.mean(meet) / nearcopies.BANDS < 0.46


def test_a_repeated_id_on_different_texts_is_judged_text_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(0, a), (1, a + " end"), (1, b), (2, b), (3, c), (3, c), (3, c + " end"), (4, "p q"), (4, "r s"), (None, "t u"), (None, "t u")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA).repartition(3)
    got = [(r["doc_id"], r["text"].removesuffix(" end")) for r in nearcopies.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([(0, a), (1, b), (3, c), (4, "p q"), (4, "r s"), (None, "t u")], key=str)


@pytest.mark.parametrize("all_linked", [False, True])
def test_the_stage_goes_through_the_fingerprints_of_op6(spark, all_linked):
    """Without any band the copies that op6 links are still found, and what it links is checked exactly."""
    words = [f"w{i}" for i in range(400)]
    rows = list(enumerate([" ".join(words), " ".join([*words, "end"]), " ".join(words[::-1]), "p q r", "s t u", ""]))
    texts = nearcopies.text_frame(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    made = [(i, s, 0 if all_linked else nearcopies.simhash.fingerprint(t.encode())) for i, t in rows for s in [nearcopies.shingle_set(t.encode())]]
    made = [(i, nearcopies._node(s), len(s), [], int(np.uint64(fp).view(np.int64))) for i, s, fp in made]
    sketches = spark.createDataFrame(made, "id long, node binary, n long, bands array<long>, fp long")
    label = {bytes(r["node"]): r["label"] for r in nearcopies.near_links(sketches, texts, nearcopies.print_groups(sketches)).collect()}
    found = [label[node] for _, node, *_ in made]
    assert found[0] == found[1] and len(set(found)) == 5
