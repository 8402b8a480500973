"""Spelling variants, chat formatting and fill-in-the-middle against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clusterloom.llm import chat, fim, spelling

CLASHING = "doc_id long, text string, id string, n long, form string, word string, key string, `a.b` string"


def clash(rows):
    return [(i, t, "x", 1, "y", "z", "k", "d") for i, t in rows]


# -- op13 -----------------------------------------------------------------------------------------------------------

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def plain_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Zb", " ", "é", "漢", "<P>", "<", "S>", "M", "\n", "\U0001f600", "?", "9", "\x00"]), max_size=30).map("".join), st.integers(1, 6))
def test_units_are_those_of_the_pattern(text, piece):
    units, want = fim.Units(text, piece=piece), UNIT.findall(text)
    assert units.n == len(want) and units.marked == any(s in text for s in fim.SENTINELS)
    assert [units.end_of(k) for k in range(len(want) + 1)] == [len("".join(want[:k])) for k in range(len(want) + 1)]


def test_fill_in_middle_is_the_plain_version_and_goes_back(spark):
    rng = np.random.default_rng(5)
    parts = ["word", "Über", " ", "\n", "1", "<P>", "<", "P>", "漢字", "\U0001f600", ".", "x"]
    weights = np.array([8, 2, 8, 1, 2, 0.2, 0.5, 0.5, 1, 1, 1, 2])
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 80)), p=weights / weights.sum())) for _ in range(400)]
    rows = [*enumerate(texts), (500, None), (501, ""), (3, texts[3]), (None, "one two"), (-7, "a b c " * 200_000), (502, "x" * 700_000), (503, "漢" * 700_000)]
    docs = spark.createDataFrame(clash(rows), CLASHING).repartition(3)
    found = fim.fill_in_middle(docs)
    got = found.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i, *plain_fim(i, t), t or "") for i, t in rows)
    assert Counter((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bad", [("<P>", "<P>x", "<M>"), ("aba", "b1", "c1"), ("é>", "<S>", "<M>"), ("<", "<S>", "<M>")])
def test_sentinels_that_outputs_do_not_split_at_are_refused(spark, bad):
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), sentinels=bad)


def test_op13_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fim.op13_fill_in_middle(spark, str(tmp_path)).collect()}
    n, form, p, m, out = plain_fim(1, "a b c d e f g")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].asDict() == {"doc_id": 1, "n": n, "form": form, "prefix_chars": p, "middle_chars": m, "output_sha256": sha(out), "restored_sha256": sha("a b c d e f g")}
    assert got[2]["restored_sha256"] == sha("") and got[2]["form"] == "plain"


# -- op12 -----------------------------------------------------------------------------------------------------------

TRICKY = st.lists(st.sampled_from([*chat.CONTROLS, *(c[0] + "\\" + c[1:] for c in chat.CONTROLS), "\\", "<", "[", "/", "s>", "INST]", "IMG]", "]", "é", "\n", "plain", "\U0001f600"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(TRICKY)
def test_escapes_hide_every_control_string_and_go_back(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[/ROLE]"]) | TRICKY, TRICKY), max_size=6))
def test_turns_are_read_back_from_the_text_alone(turns):
    formatted, learned, chars = "", [], 0
    for role, text in turns:
        one, start, end, _ = chat.format_turn(role, text)
        learned += [formatted_part for formatted_part in [chat.unescape(one[start:end])] if role == "assistant"]
        formatted += one
        chars += len(one)
    assert [(r, t) for r, t, _, _ in chat.read_turns(formatted)] == turns
    assert learned == [t for r, t in turns if r == "assistant"]
    assert all(chat.unescape(formatted[a:b]) == t for _, t, a, b in chat.read_turns(formatted))


def test_parts_become_placeholders_in_order(spark):
    part = "type string, text string, ref string, width int, height int, seconds double, pages int"
    content = [
        ("text", "see [IMG] and [", None, None, None, None, None),
        ("image", None, "a.png", 900, 448, None, None),
        ("text", "IMG]", None, None, None, None, None),
        ("audio", None, "b.wav", None, None, 2.5, None),
        ("document", None, "c.pdf", None, None, None, 3),
        ("video", None, "d.mp4", None, None, None, None),
        ("image", None, None, None, None, None, None),
        (None, None, None, None, None, None, None),
    ]
    rows = spark.createDataFrame([(1, 0, "assistant", content), (1, 1, None, None), (1, 2, "user", [("text", "[I", *[None] * 5), ("text", "MG]", *[None] * 5)])], f"conv_id long, turn long, role string, content array<struct<{part}>>")
    first, second, third = chat.format_turns(rows, content_col="content").orderBy("turn").collect()
    assert first["formatted"] == r"<s>see [\IMG] and [[IMG]IMG][AUD][DOC][ATT][IMG][ATT]</s>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", "a.png", 4 * 256), ("audio", "b.wav", 75), ("document", "c.pdf", 3072), ("other", "d.mp4", 0), ("image", None, 0), ("other", None, 0)]
    assert all(first["formatted"][a["at"] :].startswith(chat.PLACEHOLDERS[a["kind"]]) for a in first["attachments"])
    assert first["expanded"] == 4 * 256 + 75 + 3072 and first["formatted"][first["loss_start"] : first["loss_end"]] == first["formatted"][3:-4]
    assert second["formatted"] == "[ROLE][/ROLE][END]" and third["formatted"] == r"[INST][\IMG][/INST]"
    (piece,) = chat.assemble(chat.format_turns(rows, content_col="content")).collect()
    assert piece["n_turns"] == 3 and piece["expanded"] == first["expanded"] and piece["formatted"] == first["formatted"] + second["formatted"] + third["formatted"]
    assert all(piece["formatted"][a["at"] :].startswith(chat.PLACEHOLDERS[a["kind"]]) for a in piece["attachments"])


def plain_digests(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        by.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = {}
    for conv, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        out[conv] = len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned)
    return out


@pytest.mark.parametrize("size", [1, 200, chat.PIECE])
def test_conversations_in_pieces_have_the_digests_of_their_turns(spark, size):
    rng = np.random.default_rng(8)
    texts = ["", None, "hello", "</s>[INST] ok [/INST]", "[\\INST]", "ü\U0001f600" * 50, "[ROLE]x[/ROLE]y[END]", "z" * 300_000]
    rows = [(int(c) if c else None, t, str(rng.choice(["user", "assistant", "system", "tool"])), texts[int(rng.integers(0, 8))]) for c in range(12) for t in range(int(rng.integers(1, 30)))]
    rows += [(77, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(1500)] + [(78, None, None, "first"), (78, 0, "assistant", "second")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(5)
    pieces = chat.assemble(chat.format_turns(frame), size)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.conversation_digests(pieces).collect()}
    assert got == plain_digests(rows)
    if size == 200:
        own = [r for r in pieces.collect() if r["conv_id"] == 77]
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) > 100
    empty = chat.conversation_digests(chat.assemble(chat.format_turns(frame.limit(0))))
    assert empty.count() == 0


def test_op12_columns_and_the_probe(spark, tmp_path):
    spark.createDataFrame([(4, 0, "user", "hi"), (4, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in chat.op12_typed_chat(spark, str(tmp_path)).collect()}
    assert list(got[4]) == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert got[4]["formatted_chars"] == len("[INST]hi[/INST]<s></s>") and got[4]["loss_chars"] == 0
    assert (got[-1]["n_turns"], got[-1]["turns_sha256"], got[-1]["loss_chars"], got[-1]["loss_sha256"]) == plain_digests(chat.PROBE)[-1]


# -- op11 -----------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= ratio * n else None
        out[w] = [n, len(near), form, counts[form] if form else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def as_rows(frame):
    rows = frame.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def random_words(rng, n, letters, least, most):
    return {"".join(rng.choice(list(letters), int(rng.integers(least, most)))): int(rng.integers(1, 200)) for _ in range(n)}


@pytest.mark.parametrize("split", [1, 5, spelling.SPLIT])
@pytest.mark.parametrize("letters,least,most", [("ab", 6, 10), ("abé", 6, 8), ("a", 6, 30), ("abcdefgh", 6, 8)])
def test_near_words_are_those_of_brute_force(spark, letters, least, most, split):
    counts = random_words(np.random.default_rng(len(letters) + split), 250, letters, least, most)
    words = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long")
    pairs = [(r["word"], r["near"], r["near_n"]) for r in spelling.near_words(words, split).collect()]
    assert sorted(pairs) == sorted((a, b, counts[b]) for a in counts for b in counts if one_edit(a, b))
    if split == 5:
        assert as_rows(spelling.spelling_groups(words, split=split)) == plain_groups(counts)


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        lo, hi, low, high = (rng.integers(0, n + 1, 300) for _ in range(4))
        query, value = tree.report(lo, hi, low, high)
        want = sorted((q, v) for q in range(300) for v in values[lo[q] : max(lo[q], hi[q])] if low[q] <= v < high[q])
        assert sorted(zip(query.tolist(), value.tolist())) == want


def test_very_long_words_and_chains(spark):
    counts = {"x" * 3000: 9, "x" * 3001: 60, "x" * 1500 + "y" + "x" * 1499: 1, "aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "abbbbb": 3125, "bbbbbb": 15625, "lonely": 3}
    words = spark.createDataFrame([*counts.items()], "word string, n long")
    got = as_rows(spelling.spelling_groups(words))
    assert got == plain_groups(counts) and got["aaaaaa"][4] == "bbbbbb"
    assert spelling.spelling_groups(words.limit(0)).count() == 0


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_dictionary(rows):
    found = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 5}


def test_dictionary_is_that_of_the_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vocabulary = ["Straße", "ÉCLAIRS", "×times÷", "Łódźxxx", "abcdef", "Abcdefg", "naïveté", "x1y", "don't", "ĀabcdefgĀ", "word" * 5]
    rows = [(i, " ".join(rng.choice(vocabulary, 30)) + str(rng.choice(["", "\n", ",end"]))) for i in range(400)]
    rows += [(900, None), (901, ""), (None, "abcdef " * 7), (902, "longest" * 5000), (2, rows[2][1]), (903, "abcdef " * 40_000)]
    monkeypatch.setattr(spelling, "REMEMBERED", 3)
    docs = spark.createDataFrame(clash(rows), CLASHING).repartition(3)
    got = {r["word"]: r["n"] for r in spelling.dictionary(docs).collect()}
    assert got == plain_dictionary(rows)
    monkeypatch.setattr(spelling, "PIECE", 7)
    assert Counter(r for t in [rows[0][1], "a" * 40, ""] for p in spelling.runs(t) for r in p) == Counter("".join(c.lower() if c.isascii() else c for c in r).encode("latin-1") for t in [rows[0][1], "a" * 40, ""] for r in RUN.findall(t))
    assert spelling.dictionary(docs.limit(0)).count() == 0


def test_op11_columns(spark, tmp_path):
    text = "variant " * 60 + "varient " * 6 + "variantt " * 5
    pq.write_table(spark.createDataFrame([(1, text)], "doc_id long, text string").toArrow(), tmp_path / "documents.parquet")
    rows = spelling.op11_spelling_variants(spark, str(tmp_path))
    assert set(rows.columns) == {"word", "n", "n_near", "form", "form_n", "root"}
    assert as_rows(rows) == plain_groups(plain_dictionary([(1, text)]))
