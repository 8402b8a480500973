"""Benchmark decontamination with one FM-index for each shard of the training documents.

Benchmark items are cut into windows of ``WINDOW`` consecutive words (a shorter item is one window).
Each batch of documents a task reads is a shard: its words become symbols, an FM-index is built, the
windows are searched backwards through wavelet ranks, occurrences are located by sampled suffix
positions, and overlapping occurrences merge into removal spans.

The index holds every run of words that could carry a window: a word that no item has cannot be in
an occurrence, nor can a run shorter than the shortest window, so runs of known words are what is
indexed.  Nothing is shuffled: documents stay where they are read, in whole, and the benchmark comes
to them in blocks of at most ``BLOCK_BYTES`` of text, each a chained pass over the same rows.

Defined cases: a null or empty text has no words, is never hit and keeps its text; items with a null
id or without words take no part; repeated items and documents count each by itself (items by
distinct id); empty tables give empty or unmarked results; extra columns are carried unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm.common import ALNUM, alnum_words, bound_batches, raw, slices
from clusterloom.llm.fmindex import FMIndex

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 2_000_000
MARKS = "spans array<struct<start:int,end:int>>, items array<string>, n_words long"


class Windows:
    """The windows of a block of items: symbols, lengths and the items that have each window."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in alnum_words(text)]
            for at in range(max(1, len(ids) - size + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + size]), set()).add(number[name])
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.least = int(self.lengths.min(initial=size))
        self.symbols = np.zeros((len(owners), size), np.int32)
        for row, w in zip(self.symbols, owners, strict=True):
            row[: len(w)] = w
        sizes = np.array([len(x) for x in owners.values()], np.int64)
        self.owner_at = np.concatenate(([0], np.cumsum(sizes)))
        self.owners = np.fromiter(chain.from_iterable(sorted(x) for x in owners.values()), np.int64, int(sizes.sum()))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] numbers for each i."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(counts.sum()))


def mark(texts: list[bytes], windows: Windows) -> tuple[list[list[tuple[int, int]]], list[list[str]], np.ndarray]:
    """For each text: merged spans of hit words, names of the items found, number of words."""
    n = len(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    counts, parts = np.zeros(n, np.int64), []
    get, stop = windows.vocab.get, np.zeros(1, np.int32)
    for i, text in enumerate(texts):
        words = alnum_words(text)
        counts[i] = len(words)
        parts += np.fromiter(map(get, words, repeat(0)), np.int32, len(words)), stop
    if not n or not len(windows.lengths):
        return spans, items, counts
    ids = np.concatenate(parts)
    begins = np.concatenate(([0], np.cumsum(counts + 1)[:-1]))  # where each text begins in ids
    known = np.concatenate(([False], ids != 0, [False]))
    edge = np.flatnonzero(known[1:] != known[:-1])
    start, end = edge[::2], edge[1::2]
    keep = end - start >= windows.least
    start, size = start[keep], (end - start)[keep]
    if not len(start):
        return spans, items, counts
    source = ragged(start, size + 1)  # with the unknown word or text end behind each run
    symbols = ids[source]
    index = FMIndex(symbols, len(windows.vocab))
    who, lo, hi = index.search(windows.symbols, windows.lengths)
    if not len(who):
        return spans, items, counts
    times = hi - lo
    at = source[index.locate(ragged(lo, times))]
    which = np.repeat(who, times)
    long = windows.lengths[which]
    delta = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + long, minlength=len(ids) + 1)
    hit = np.concatenate(([False], np.cumsum(delta) > 0))
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    doc = np.searchsorted(begins, edge[::2], side="right") - 1
    for d, a, b in zip(doc.tolist(), (edge[::2] - begins[doc]).tolist(), (edge[1::2] - begins[doc]).tolist(), strict=True):
        spans[d].append((a, b))
    doc = np.searchsorted(begins, at, side="right") - 1
    pairs = np.unique(doc * len(windows.lengths) + which)
    doc, which = np.divmod(pairs, len(windows.lengths))
    owns = windows.owner_at[which + 1] - windows.owner_at[which]
    pairs = np.unique(np.repeat(doc, owns) * len(windows.names) + windows.owners[ragged(windows.owner_at[which], owns)])
    for d, k in zip(*(x.tolist() for x in np.divmod(pairs, len(windows.names))), strict=True):
        items[d].append(windows.names[k])
    return spans, items, counts


def _pieces(text: bytes, size: int, most: int) -> Iterator[tuple[int, int, bytes]]:
    """(first word, words before that one that are repeated, bytes) of pieces of about ``most`` bytes; windows
    across a cut stand whole in the later piece."""
    flat, at, done, tail = text.translate(ALNUM), 0, 0, []
    while at < len(flat):
        end = flat.find(b" ", at + most) if at + most < len(flat) else -1
        end = len(flat) if end < 0 else end
        words = flat[at:end].split()
        yield done, len(tail), b" ".join([*tail, *words])
        done, tail, at = done + len(words), [*tail, *words][-(size - 1) :] if size > 1 else [], end


def mark_long(text: bytes, windows: Windows, most: int) -> tuple[list[tuple[int, int]], list[str], int]:
    """``mark`` of one text in pieces, for texts that no shard should hold whole."""
    size = windows.symbols.shape[1]
    spans, items, total = [], set(), 0
    for first, again, piece in _pieces(text, size, most):
        found, names, n = mark([piece], windows)
        spans += [(a + first - again, b + first - again) for a, b in found[0]]
        items.update(names[0])
        total = first + int(n[0]) - again
    return _merged(spans), sorted(items), total


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _marked_batches(batches: Iterator[pa.RecordBatch], block, text_at: int) -> Iterator[pa.RecordBatch]:
    windows = block.value
    for batch in slices(batches, 4000):
        row = batch.column(0)
        texts = raw(row.field(text_at))
        first = 0
        while first < len(texts):  # shards of bounded size, also where a batch holds many long texts
            last, held = first, 0
            while last < len(texts) and (last == first or held + len(texts[last]) // 2 <= SHARD_WORDS):
                held += len(texts[last]) // 2
                last += 1
            if last == first + 1 and len(texts[first]) > 2 * SHARD_WORDS:
                span, names, n = mark_long(texts[first], windows, 2 * SHARD_WORDS)
                spans, items, counts = [span], [names], np.array([n], np.int64)
            else:
                spans, items, counts = mark(texts[first:last], windows)
            before = batch.slice(first, last - first)
            if batch.num_columns > 1:  # a later block: add to what earlier ones found
                old = before.column(1).to_pylist()
                spans = [_merged([(x["start"], x["end"]) for x in a] + b) for a, b in zip(old, spans, strict=True)]
                items = [sorted({*a, *b}) for a, b in zip(before.column(2).to_pylist(), items, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            as_dicts = [[{"start": a, "end": b} for a, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays(
                [before.column(0), pa.array(as_dicts, kind), pa.array(items, pa.list_(pa.string())), pa.array(counts)],
                names=["row", "spans", "items", "n_words"],
            )
            first = last


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> Iterator[Windows]:
    """The benchmark's windows in blocks of bounded text, one block in the driver at a time."""
    rows = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-held // BLOCK_BYTES) or 1
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        yield Windows([(r["item"], r["text"].encode()) for r in part.toLocalIterator()], window)


def marked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(row, spans, items, n_words): each document's columns as a struct, merged spans of hit words
    (end exclusive), names of the items with a window in it, and its number of words."""
    bound_batches(docs.sparkSession)
    out = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"))
    kind = out.schema["row"].dataType.simpleString() if all(re.fullmatch(r"\w+", c) for c in docs.columns) else None
    at = docs.columns.index(text_col)
    schema = f"row {kind}, {MARKS}" if kind else out.withColumns({n: F.lit(None).cast(t) for n, t in (("spans", "array<struct<start:int,end:int>>"), ("items", "array<string>"), ("n_words", "long"))}).schema
    for windows in benchmark_blocks(benchmark, item_col, item_text_col, window):
        block = docs.sparkSession.sparkContext.broadcast(windows)
        out = out.mapInArrow(partial(_marked_batches, block=block, text_at=at), schema)
    return out


_WORD = re.compile(rb"[^ ]+")


def _without(text: str | None, spans) -> str | None:
    if not spans:
        return text
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data.translate(ALNUM))]
    out, last = [], 0
    for s in spans:
        out.append(data[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return b"".join([*out, data[last:]]).decode()


def _cut_batches(batches: Iterator[pa.RecordBatch], text_at: int, chars_at: int | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        row = batch.column(0)
        spans = batch.column(1).to_pylist()
        fields = row.flatten()
        if any(spans):
            texts = [_without(t, s) for t, s in zip(fields[text_at].to_pylist(), spans, strict=True)]
            fields[text_at] = pa.array(texts, fields[text_at].type)
            if chars_at is not None:
                old = fields[chars_at].to_pylist()
                fields[chars_at] = pa.array([len(t) if s else c for t, s, c in zip(texts, spans, old, strict=True)], fields[chars_at].type)
        yield pa.RecordBatch.from_arrays(fields, names=[f.name for f in row.type])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **more) -> DataFrame:
    """The documents with every removal span cut out of the text; a character count column follows."""
    found = marked(docs, benchmark, text_col, **more).select("row", "spans")
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None
    return found.mapInArrow(partial(_cut_batches, text_at=docs.columns.index(text_col), chars_at=chars), docs.schema)


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = marked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]), F.lit(0)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS l, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, l, i, array_to_string(w[i : i + l - 1], ' ') AS g
       FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
h AS (SELECT dw.rid, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
