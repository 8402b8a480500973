"""The whole pipeline against a plain version of each stage, on planted rejects, copies and benchmark passages."""

import duckdb
import numpy as np

import corpus_pipeline
from clusterloom.llm import mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, int(rng.integers(40, 90)))) for _ in range(60)]
    passage = " ".join(rng.choice(words, 14))
    for i in (3, 11, 40):
        t = texts[i].split()
        texts[i] = " ".join([*t[:20], *passage.split(), *t[20:]])
    for i in range(8):
        t = texts[i].split()
        t[-1] = f"new{i}"
        texts.append(" ".join(t))
    texts += [texts[9], texts[9], texts[10].upper(), "", None]
    bad = [" ".join("JUNK!! $$$ BUY".split() * int(rng.integers(8, 20))) + f" Z{i}" for i in range(40)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts + bad)]
    labels = [(i, int(i < len(texts)), 0) for i in range(len(rows))]
    return rows, labels, [(1, passage), (2, "never seen " * 10)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_is_its_plain_version(spark, tmp_path):
    rows, labels, benchmark = planted()
    tables = {"documents": (rows, SCHEMA), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": (benchmark, "item_id long, text string")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted((r["doc_id"], r["text"] or "", r["n_chars"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = quality.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, tables["labels"][1]))
    left = [r for r in rows if model.score(quality.features((r[1] or "").encode())) >= quality.THRESHOLD]
    assert {r[0] for r in left} >= {i for i in range(60)} and not any("JUNK" in (r[1] or "") for r in left)

    label = {r[0]: r[0] for r in left}
    sets = {r[0]: shingles(r[1]) for r in left}
    for i in label:
        for j in label:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if x == old else x for k, x in label.items()}
    left = [r for r in left if label[r[0]] == r[0]]
    assert len(left) <= 61

    item = benchmark[0][1].split()
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    clean = []
    for i, text, lang, source, n in left:
        w = (text or "").split()
        hit = {k for p in range(len(w) - 9) if tuple(w[p : p + 10]) in windows for k in range(p, p + 10)}
        if hit:
            assert len(hit) >= 14
            text = " ".join(w[: min(hit)]) + "  " + " ".join(w[max(hit) + 1 :])
            n = len(text)
        clean.append((i, text, lang, source, n))

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", clean)
    taken = {i: (size, n) for i, size, n in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.OP9_SQL})").fetchall()}
    want = sorted((i, t or "", n) for i, t, _, _, n in clean for _ in range(taken[i][1] // taken[i][0] if taken[i][0] else sum(g[0] == i for g in got)))
    assert got == want
