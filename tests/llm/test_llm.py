"""The corpus operators against brute force, on small tables with nulls, ties, copies and odd columns."""

import hashlib
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer
from pyspark.sql import functions as F

import corpus_pipeline
from clusterloom.llm import common, decontaminate, huffman, licenses, mixing, pii, quality, repeats, sharding, simhash, tokens, topk

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa mit license apache general public".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, k string, size long"


def make_docs(seed=0, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS, int(rng.integers(0, 60))))
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, rows[3][1]), (102, rows[3][1]), (None, rows[4][1]), (103, "Ünïcode é " * 50), (104, "x" * 30000)]
    return [(i, t, "en", None if (i or 0) % 7 == 0 else f"s{(i or 0) % 4}", len(t or ""), 7, "clash", "clash", 9) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pii_base_spans(spark, nothing):
    texts = ["a@b.co c@d 1.2.3.4 999.1.1.1", "4111 1111-1111 1111, +1 (212) 555-0100 x", "1.2.3.4.5.6.7.8 a@b@c.de", None, "", "é a@b.co"]
    got = {r["id"]: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for _, r in sorted(got.items())] == [(1, 1, 0, 0), (0, 0, 1, 1), (1, 2, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0)]
    assert got[5]["base_sha256"] == hashlib.sha256(b"email:2:8").hexdigest() and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(nothing).count() == 0


def test_pii_beliefs_follow_the_votes():
    pattern = np.array([int("111121", 3), int("002202", 3)])
    belief = pii.reliabilities(np.array([2, 2]), pattern, np.array([50.0, 50.0]))
    assert belief[0] > 0.9 > 0.1 > belief[1]


def test_pii_finds_what_is_planted_and_leaves_decoys(spark):
    """Recall of each kind's planted forms, beside decoys of the same look; base spans are those of the plain patterns."""
    rng = np.random.default_rng(3)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))

    def card(good=True):
        while True:
            number = str(rng.choice(["4", "51", "55"])) + digits(15)
            if pii.luhn(number[:16]) == good and pii._issuer(number[:16]):
                return number[:16]

    forms = {
        "email": [lambda: f"jörg{digits(2)}@müller.de", lambda: f"anna{digits(2)} [at] mail{digits(1)}.example.com", lambda: f"hans{digits(2)} at firm{digits(1)} dot com"],
        "card": [lambda: card() + " " + card()],
        "phone": [lambda: f"({digits(3)}) 5{digits(2)}-{digits(4)}", lambda: f"+1 ({digits(3)}) 555-{digits(4)} 2810148878564"],
        "ssn": [lambda: f"ssn 1{digits(1)}3-4{digits(1)}-678{rng.integers(1, 9)}"],
        "secret": [lambda: f'token = "{hexes(40)}"', lambda: f"password: Xy{hexes(9)}!", lambda: f"AKIA{hexes(16).upper()}", lambda: f"TOKEN = \"{hexes(40).upper()}\"!!", lambda: f"key {hexes(64)}"],
        "name": [lambda: "Mr. Thomas Weber", lambda: "Dear Laura Schmidt"],
    }
    decoys = [lambda: card(False), lambda: f"version 1.{digits(1)}.0.{digits(1)}", lambda: f"isbn 978-{digits(10)}", lambda: "a" * 50, lambda: f"commit {hexes(12)}", lambda: f"000-12-{digits(4)}", lambda: f"{digits(6)}-{digits(2)}"]
    words = "the quick brown fox jumps over lazy dogs and returns".split()
    around = lambda x: " ".join([*rng.choice(words, 12), x, *rng.choice(words, 12)])
    rows, want = [], {}
    for kind, makers in forms.items():
        for make in makers:
            for _ in range(12):
                want[len(rows)] = kind
                rows.append(around(make()))
    for make in decoys:
        for _ in range(40):
            rows.append(around(make()))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["id"]: r for r in pii.personal_data(docs).collect()}
    for kind in forms:
        ids = [i for i, k in want.items() if k == kind]
        assert sum(got[i][f"added_{kind}"] > 0 for i in ids) >= 0.9 * len(ids), kind
    clean = [i for i in range(len(rows)) if i not in want]
    assert sum(not any(got[i][f"added_{k}"] for k in pii.KINDS) for i in clean) >= 0.95 * len(clean)  # a version may be a base span
    for i, text in enumerate(rows):
        spans = [s.split(":") for s in got[i]["spans"].split(",") if s]
        assert got[i]["n_spans"] == len(spans) and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))
        assert all(0 <= int(a) < int(b) <= len(text) for _, a, b in spans)


def plain_base_spans(text):
    """The contract's patterns, taken literally."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for name, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m.group())
            if least <= len(number) <= most and (name == "phone" or pii.luhn(number)):
                out.append((name, *m.span()))
    return out


def test_pii_base_spans_are_those_of_the_plain_patterns(spark):
    rng = np.random.default_rng(12)
    parts = list("0123456789@.+-() aé%_") + ["@b.co", "1.2.3.4", "4111111111111111", "+1 (212) 555-0100", "token=", "at"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 40)))) for _ in range(1500)] + [None, "9" * 5000, "a@" * 3000 + "b.c"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, id string, `spans.x` string")
    for r in pii.personal_data(docs).collect():
        base = plain_base_spans(texts[r["id"]] or "")
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(b[0] == k for b in base) for k in pii.BASE], texts[r["id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r["spans"].split(","))


def kept_by_brute_force(texts):
    """(bytes, removed bytes, spans, hash of the rest) of each text, from a count of all windows."""
    count = {}
    for t in texts:
        for p in range(len(t) - 199):
            count[t[p : p + 200]] = count.get(t[p : p + 200], 0) + 1
    want = []
    for t in texts:
        covered = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                covered[p + 1 : p + 201] = True
        spans = int((covered[1:] & ~covered[:-1]).sum())
        covered = covered[1:-1]
        want.append((len(t), int(covered.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~covered].tobytes()).hexdigest()))
    return want


def passages(seed=5):
    rng = np.random.default_rng(seed)
    some = [bytes(rng.integers(97, 100, int(rng.integers(150, 400)), dtype=np.uint8)) for _ in range(6)]
    texts = [b"".join(some[rng.integers(0, 6)][int(rng.integers(0, 60)) :] for _ in range(int(rng.integers(0, 4)))) for _ in range(30)]
    return [*texts, b"a" * 500, b"", "é".encode() * 150, b"ab" * 400, texts[5]]


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats(spark, nothing, hot):
    texts = passages()
    rows = [(i % 34, t.decode()) for i, t in enumerate(texts)] + [(77, None)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, part string, `a.b` int").repartition(3)
    got = [(r["id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in repeats.repeated_spans(docs, hot=hot).collect()]
    assert sorted(got) == sorted((i, *w) for (i, _), w in zip(rows, kept_by_brute_force([(t or "").encode() for _, t in rows]), strict=True))
    assert repeats.repeated_spans(nothing).count() == 0


def spans_in_one_part(texts, hot):
    """The operator's steps without Spark, all texts in one part and one task."""
    columns = []
    for a in repeats._chunks(texts):
        columns.append((a.gram, *repeats._halves(a.contexts(np.arange(len(a.at)))), np.zeros(len(a.at), np.int64), np.ones(len(a.at), np.int64)))
    gram, c0, c1, part, times = (np.concatenate(x) for x in zip(*columns, strict=True))
    grams, contexts, total = repeats.gram_counts(gram, c0, c1, times)
    kinds = {int(g): 0 if n < 2 else repeats.WINDOWS if n > hot else repeats.SHIP for g, n, t in zip(grams, contexts, total, strict=True) if t > 1}
    judged = [pickle.dumps([c for c in repeats.judge(gram, c0, c1, part, times, kinds)[1:]])]
    sent = list(repeats._contexts(texts, 0, judged, 1))
    solved = repeats._solved([k for k, _, _ in sent], [p for _, _, p in sent])
    return repeats._spans(texts, judged, [p for _, p in solved])


@pytest.mark.parametrize("hot", [4096, 2])
@pytest.mark.parametrize("chunk", [1 << 20, 700])
@pytest.mark.parametrize("weak", [False, True])
def test_repeats_in_pieces_and_with_clashing_hashes(monkeypatch, hot, chunk, weak):
    """Long texts are cut into pieces; unlike grams share a hash; neither may add or lose a removed byte."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    if weak:
        monkeypatch.setattr(repeats, "_mix", lambda h: ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(60)) << np.uint64(60))
    rng = np.random.default_rng(8)
    texts = passages(6)
    texts += [b"".join([texts[k] for k in rng.integers(0, 30, 40)]), bytes(rng.integers(97, 123, 5000, dtype=np.uint8))]
    for t, s, want in zip(texts, spans_in_one_part(texts, hot), kept_by_brute_force(texts), strict=True):
        assert (len(t), sum(y - x for x, y in s), len(s)) == want[:3]


def test_maximal_groups_are_those_of_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(2, 14))
        before = [bytes(rng.integers(97, 99, int(rng.integers(0, 6)), dtype=np.uint8)) for _ in range(n)]
        after = [b"GG" + bytes(rng.integers(97, 99, int(rng.integers(0, 6)), dtype=np.uint8)) for _ in range(n)]
        want = set()
        for i in range(n):
            for j in range(i):
                left, right = repeats._common(before[i], before[j]), repeats._common(after[i], after[j])
                if left + right >= 4:
                    want.add((left, right, tuple(k for k in range(n) if before[k][:left] == before[i][:left] and len(before[k]) >= left and after[k][:right] == after[i][:right] and len(after[k]) >= right)))
        got = [(x, y, tuple(sorted(g))) for x, y, g in repeats.maximal_groups(before, after, 4)]
        assert len(got) == len(set(got)) and set(got) == want


def test_shards_round_trip(spark, docs, nothing, tmp_path):
    store = sharding.shard_documents(docs, str(tmp_path / "a"), target=1 << 20)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    assert len(store.shards()) == 1
    with pytest.raises(Exception, match="exist"):
        store.commit(store.version() - 1, docs.schema, [])
    empty = sharding.shard_documents(nothing, str(tmp_path / "b"))
    assert empty.read().count() == 0 and empty.version() == 1


def test_many_merges_run_in_several_jobs(spark, tmp_path, monkeypatch):
    """Each merged shard is one file near the target size, versions commit one after another, and no row is lost."""
    monkeypatch.setattr(sharding, "MERGES", 2)
    store = sharding.ShardStore(spark, str(tmp_path / "m"))
    rows = spark.range(40_000).selectExpr("id", "sha2(cast(id as string), 256) AS text")
    store.append_arrivals(rows, F.col("id") % 24)
    before = store.shards()
    target = 4 * max(s.size for s in before)
    store.compact(target)
    after = store.shards()
    assert len(after) < len(before) / 2 and max(s.size for s in after) <= 1.2 * target and store.version() > 24
    assert store.read().count() == 40_000 and store.read(3).count() < 40_000
    assert store.read().agg(F.sum("id")).first()[0] == sum(range(40_000))
    store.expire()
    assert store.read().select("id").distinct().count() == 40_000


def test_merges_pack_similar_runs():
    small = [sharding.Shard(f"s{i}", 100) for i in range(10)]
    groups = sharding.plan_merges([*small, sharding.Shard("big", 10**9)], target=500, smallest=1000)
    assert {s.path for g in groups for s in g} == {s.path for s in small} and all(sum(s.size for s in g) <= 550 for g in groups)
    assert sharding.plan_merges(small[:3], target=500, smallest=1000) == []


def test_quality(spark, docs, nothing):
    good = [(i, " ".join(f"word{(i * 7 + j) % 50}" for j in range(20))) for i in range(60)]
    bad = [(i, " ".join(f"JUNK{(i + j) % 9}!!" for j in range(20))) for i in range(60, 120)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    got = {r["id"]: r["score"] for r in quality.score(table, model).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i] >= 0.3) == (i < 60) for i in held)
    assert quality.score(docs, model).where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.train(nothing, labels).score(np.zeros(0, np.int64)) == 1.0


def plain_fingerprint(text, n=3):
    """The contract's rule, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_long_texts_go_piece_by_piece(monkeypatch):
    """Fingerprints and features do not depend on where a text is cut."""
    rng = np.random.default_rng(4)
    parts = ["Ab", "é", "x!", "aa", "12", "ÀB", "\x00z", "\x1cq"]
    for _ in range(60):
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n", "\x0b", "\t "]) for _ in range(int(rng.integers(0, 60))))
        whole = quality.features(text.encode()).tolist()
        for size in (1, 7, 40):
            with monkeypatch.context() as m:
                m.setattr(simhash, "word_pieces", lambda t, size=size: common.word_pieces(t, size))
                m.setattr(quality, "PIECE", size)
                assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
                assert quality.features(text.encode()).tolist() == whole
    assert simhash.fingerprint(b" \n") == 0


def test_a_bounded_sample_is_fitted(spark):
    table = spark.createDataFrame([(i, f"{'good' if i % 2 else 'BAD!!'} w{i} " * 9) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    model = quality.train(table, labels, places=1500)
    held = quality.score(table, model).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["id"] % 2 == 1) for r in held]) > 0.9


def test_huffman_round_trip():
    rng = np.random.default_rng(1)
    counts = np.zeros(1000, np.int64)
    counts[rng.choice(1000, 300, replace=False)] = (rng.pareto(0.3, 300) * 5 + 1).clip(1, 10**12)
    lengths = huffman.code_lengths(counts)
    used = np.flatnonzero(counts)
    assert lengths.max() <= huffman.MAX_BITS and (2.0 ** -lengths[used].astype(float)).sum() == 1
    ids = rng.choice(used, 3001)
    bits, at = huffman.encode(ids, huffman.canonical_codes(lengths), lengths)
    assert all((x == ids).all() for x in huffman.decode([(bits, at, len(ids))] * 2, huffman.decode_table(lengths)))


def test_token_files(spark, docs, rows, nothing, tmp_path):
    path = tokens.tokenizer_file()
    odd = ["<|endoftext|> a", "don't\x85stop\x1cnow 12", "İstanbul ǅ ﬁ", "é é ̈x", "a\r\nb\tc"]
    tokenizer = tokens.WordTokenizer(path)
    library = Tokenizer.from_file(path)
    whole = lambda t: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
    for t, got in zip(odd, tokenizer.encode(pa.array(odd)).to_pylist(), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == whole(t).tolist()
    tokens.write_tokens(docs, str(tmp_path / "t"), path)
    read = tokens.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r["start"] for r in read] == np.cumsum([0, *(r["n_tokens"] for r in read[:-1])]).tolist()
    got = [(r["id"], r["n_tokens"], r["ids_crc32"]) for r in read]
    key = lambda x: (x[0] is not None, x)
    want = [(r[0], len(whole(r[1] or "")), zlib.crc32(whole(r[1] or "").tobytes())) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key) and [g[0] for g in got][1:] == sorted(g[0] for g in got if g[0] is not None)
    tokens.write_tokens(nothing, str(tmp_path / "e"), path)
    assert tokens.read_tokens(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("together", [8 << 20, 64])
def test_tokenizer_is_the_library(monkeypatch, together):
    """Random texts of the awkward: contractions, marks, special tokens, other scripts, blanks of all kinds."""
    monkeypatch.setattr(tokens, "TOGETHER", together)
    monkeypatch.setattr(tokens, "MEMO_WORDS", 500)
    library, own = Tokenizer.from_file(tokens.tokenizer_file()), tokens.WordTokenizer(tokens.tokenizer_file())
    parts = "' s t re ve ll m d 1 é É İ Σ ς ﬁ ǅ <|endoftext|> <| |> endoftext a B ! . 😀 𝒳 中 한 가 ́ ½ Ⅷ _ K ſ ÿ 𐐀".split(" ")
    parts += [" ", "\n", "\t", "\r\n", "\x85", "\xa0", "\u3000", "\x1c", "\x0b", "\x00", "\u200b", " \u0308"]
    rng = np.random.default_rng(9)
    for _ in range(4):
        texts = ["".join(rng.choice(parts, int(rng.integers(0, 40)))) for _ in range(800)]
        for t, got in zip(texts, own.encode(pa.array(texts)).to_pylist(), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], t


def test_long_blocks_are_coded_piecewise(monkeypatch):
    monkeypatch.setattr(huffman, "TOGETHER", 512)
    rng = np.random.default_rng(6)
    ids = rng.choice(900, 5000, p=np.arange(1, 901) / np.arange(1, 901).sum())
    lengths = huffman.code_lengths(np.bincount(ids, minlength=900))
    bits, at = huffman.encode(ids, huffman.canonical_codes(lengths), lengths)
    monkeypatch.setattr(huffman, "TOGETHER", 1 << 18)
    assert (bits, at.tolist()) == ((x := huffman.encode(ids, huffman.canonical_codes(lengths), lengths))[0], x[1].tolist())
    monkeypatch.setattr(huffman, "TOGETHER", 512)
    assert all((x == y).all() for x, y in zip(huffman.decode([(bits, at, 5000), (b"", [], 0), (bits, at, 5000)], huffman.decode_table(lengths)), [ids, ids[:0], ids], strict=True))


def test_simhash(spark, docs, rows, nothing):
    got = simhash.near_duplicate_components(docs).collect()
    assert len(got) == len(rows)
    words = "The Quick brown fox".lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(2)]
    assert simhash.fingerprint(b"The Quick brown  fox") == h[0] & h[1]
    prints = {}
    for r in got:
        prints.setdefault(r["fp"], []).append(r)
    codes = list(prints)
    label = {c: c for c in codes}
    for _ in codes:
        for a in codes:
            for b in codes:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for r in got:
        if r["id"] is not None:
            least[label[r["fp"]]] = min(r["id"], least.get(label[r["fp"]], r["id"]))
    assert all(r["component"] == least.get(label[r["fp"]]) for r in got)
    assert simhash.near_duplicate_components(nothing).count() == 0


@pytest.mark.parametrize("split", [4096, 20])
def test_gray_index_links(spark, split):
    rng = np.random.default_rng(3)
    codes = set()
    for base in rng.integers(0, 2**62, 2):
        for _ in range(200):
            x = int(base)
            for _ in range(int(rng.integers(0, 6))):
                x ^= 1 << int(rng.integers(0, 62))
            codes.add(x)
    codes = sorted(codes)
    place = {c: i for i, c in enumerate(codes)}
    want, got = simhash._Forest(len(codes)), simhash._Forest(len(codes))
    pairs = [(place[a], place[b]) for a in codes for b in codes if a < b and bin(a ^ b).count("1") <= 2]
    want.merge(*np.array(pairs).T)
    links = simhash.near_links(spark.createDataFrame([(c,) for c in codes], "fp long"), split=split).collect()
    got.merge(*np.array([(place[r["src"]], place[r["dst"]]) for r in links]).T)
    assert (want.label == got.label).all() and len(links) < 6 * len(codes)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "LEAST_SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 5)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(2)
    vecs = [[float(x) for x in v] for v in rng.normal(size=(150, 6)).round(1)]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(i, vecs[0]) for i in range(200, 260)] + [(40, vecs[40]), (300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (320, [0.5, -0.5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), 7, F.col("id") % 20 == 0, "vec_id", "embedding").collect()
    real = [(i, np.array([int(np.floor(64 * np.float64(np.float32(x)))) for x in v] + [0] * (6 - len(v)))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (i, q) in enumerate(real):
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for m, (j, v) in enumerate(real) if m != n)[:7]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, 7, F.col("id") % 20 == 0, "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("most", [100, 2**20, 2**27, 2**29])
def test_tree_search_is_exact_for_large_components(monkeypatch, most):
    """Scores beyond a double's mantissa, many ties: the same tree search, in halves."""
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(most % 97)
    points = rng.integers(-most, most + 1, (120, 5))
    points[60:90] = points[:30]
    tree = topk.build_tree(np.arange(120), np.arange(120), points, 7)
    pairs, scores = topk.search(tree, points[::6], np.arange(120)[::6], np.full(20, topk.NOTHING), 7)
    got = sorted((int(w), int(tree["ids"][f]), int(s)) for (w, f), s in zip(pairs, scores, strict=True))
    want = []
    for w, i in enumerate(range(0, 120, 6)):
        every = sorted((-sum(int(x) * int(y) for x, y in zip(points[i], points[j], strict=True)), j) for j in range(120) if j != i)[:7]
        want += [(w, j, -s) for s, j in every]
    assert got == sorted(want)


def test_licenses(spark, docs, rows, nothing):
    got = licenses.license_places(docs).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for r in rows:
        words = word.findall((r[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        places = sum(words[i : i + len(p.split())] == p.split() for p in licenses.PHRASES for i in range(len(words)))
        want.append((len(words), places))
    assert sorted((r["n_words"], len(r["base"])) for r in got) == sorted(want)
    assert licenses.license_places(nothing).count() == 0
    a = licenses.Automaton("by the <<optional>>old<<end>> rule <<any 2>> done")
    assert a.longest(b"by the rule done".split(), 0) == 4 and a.longest(b"by the old rule x y done".split(), 0) == 7
    assert a.longest(b"by the new rule done".split(), 0) == -1 and a.longest(b"by the rule x y z done".split(), 0) == -1


@pytest.mark.parametrize("name", ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "Apache-2.0-header", "GPL-header"])
def test_license_wording_must_match_in_whole(name):
    """The template's own words are found; each mandatory word that is changed or left out refuses the text."""
    template = re.sub(r"<<any \d+>>", "someone", licenses.TEMPLATES[name])
    plain = re.sub(r"<<optional>>.*?<<end>>", " ", template, flags=re.S).split()
    found = lambda words: name in {label for _, _, label in licenses.scan(" ".join(["see", *words, "bye"]).encode())[2]}
    assert found(plain) and found(re.sub("<<optional>>|<<end>>", " ", template).split()) and found([w.upper() for w in plain])
    assert not found(plain[: len(plain) // 2]) and not found(plain[:-1])
    for i, w in enumerate(plain):
        if w != "someone" and "someone" not in plain[max(0, i - 9) : i + 2]:
            assert not found([*plain[:i], "nobody", *plain[i + 1 :]]) and (w in plain[i + 1 : i + 2] or not found([*plain[:i], *plain[i + 1 :]])), (i, w)


def test_mix(spark, docs, rows, nothing):
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["size"] for r in got) == sum(len((r[1] or "").split()) for r in rows)
    targets = {(r["source_size"], r["target"]) for r in got}
    assert all(t <= 3 * s + 1e-9 for s, t in targets) and abs(sum(t for _, t in targets) - sum(r["size"] for r in got)) < 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_plan(nothing).count() == 0


def test_decontamination(spark, docs, rows, nothing):
    items = [(1, " ".join(rows[8][1].split()[2:14])), (2, "ALPHA, beta"), (3, None), (4, "--"), (None, "gamma"), (2, "alpha beta")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").lower() if (t or "").isascii() else (t or ""))
    windows = {(i, tuple(w[k : k + 10])) for i, t in items if i is not None and (w := cut(t)) for k in range(max(1, len(w) - 9))}
    want = []
    for r in rows:
        w, hit, names = cut(r[1]), set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    names.add(str(i))
        want.append((str(r[0]), len(w), len(hit), sorted(names)))
    got = [(str(r["row"]["doc_id"]), r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), sorted(r["items"])) for r in decontaminate.marked(docs, benchmark).collect()]
    assert sorted(got) == sorted(want)
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.schema == docs.schema and clean.count() == len(rows)
    kept = {r["doc_id"]: len(cut(r["text"])) for r in clean.collect()}
    assert all(kept[int(i)] == n - h for i, n, h, _ in want if i != "None")
    assert decontaminate.marked(nothing, benchmark).count() == 0 and decontaminate.marked(docs, benchmark.limit(0)).where("size(spans) > 0").count() == 0


def test_long_text_is_marked_in_pieces():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    text = " ,".join(rng.choice(words, 4000)).encode()
    parts = text.decode().replace(",", "").split()
    items = [(str(i), " ".join(parts[a : a + 14]).encode()) for i, a in enumerate(rng.integers(0, 3980, 25))] + [("s", b"W3 w4"), ("one", b"w7")]
    windows = decontaminate.Windows(items)
    spans, names, counts = decontaminate.mark([text], windows)
    for most in (50, 333, 5000):
        assert decontaminate.mark_long(text, windows, most) == (decontaminate._merged(spans[0]), names[0], int(counts[0]))


def test_dotted_and_clashing_columns_travel(spark):
    rows = [(i, f"alpha beta gamma {i % 3} " * 12, f"s{i % 2}", 5, "x", 1) for i in range(40)] + [(None, "a b c", None, 1, "y", 2), (None, "d e", None, 1, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int, shard string, row int").repartition(2)
    benchmark = spark.createDataFrame([(1, "alpha beta gamma 0 alpha beta gamma 0 alpha beta")], "item_id long, text string")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == 42 and clean.where("text like '%alpha beta gamma 0%'").count() == 0
    sharded = corpus_pipeline.shard(spark, docs, "")
    assert sharded.columns == [*docs.columns, "_shard"] and sharded.where("shard in ('x', 'y')").count() == 42


def test_pipeline_stages_keep_their_promises(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, d).toPandas()) if k < 4 else stage(spark, docs, d)
        assert set(columns) <= set(docs.columns) and (docs.count() <= before or k == 3)
    assert docs.count() > 0
