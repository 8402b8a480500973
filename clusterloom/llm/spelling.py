"""Spelling variants: words one edit apart, found by reporting points in two orders of the dictionary.

Occurrences are counted per task before the shuffle.  A near word has the prefix before an edit position and the suffix
behind it in common, so with the words of one length as points (rank among them, rank among them read backwards) every
edit position asks for the points in a rectangle: an interval of the forward order by an interval of the reverse order.
A wavelet tree over the reverse ranks in forward order reports them.  Words of length L ask words of length L
(replaced) and of L + 1 (inserted; deletions are the same links from the other end).

The dictionary is dealt by what an edit leaves alone: an edit in the second half of the positions leaves the first half of
the word, one in the first half the second.  Words that share that half meet in a group; a group above ``SPLIT`` words
halves its positions again, down to one position, where a group has no more words than the alphabet has letters.  No
group is cut and every link is found, once: at the first of the positions that explain it.

Defined cases: a null text has no words, a null id is hashed as the empty text; repeated rows count again; ties in
count go to the word smaller in code-point order; an empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm.common import slices, strings, text_frame
from clusterloom.sources.storage import stored

#: One of so many hashed runs is misspelt, a stand-in for typing errors.
ERRORS = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent.
RATIO = 5
#: Words and questions of a group at most, where its positions can still be halved.
SPLIT = 1 << 17
#: Bytes of words that are indexed at a time, about: whole groups only.
INDEXED = 1 << 21
#: Different words that a task remembers before it hands on their counts.
REMEMBERED = 1 << 17
#: Code points of a text that are cut into words at a time.
PIECE = 1 << 20

#: Letters are A-Z, a-z and U+00C0 to U+00FF; of these A-Z go to lower case, anything else ends a run.
_RUNS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0xC0 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of a text as Latin-1 bytes, those of about ``PIECE`` code points at a time."""
    plain = text.encode("latin-1", "replace").translate(_RUNS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def word_of(run: bytes, seed: int, errors: int) -> bytes:
    """``run`` as it counts; ``seed`` is the checksum of what stands before it in the hashed text."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % errors:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches: Iterator[pa.RecordBatch], errors: int, least: int) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def told() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return found

    for batch in slices(batches, 100):
        for i, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            seed = zlib.crc32(f"{'' if i is None else i}:".encode())
            for words in runs(text):
                for run, n in Counter(words).items():
                    if len(run) >= least and len(word := word_of(run, seed, errors)) >= least:
                        total[word] += n
                if len(total) > REMEMBERED:
                    yield told()
    yield told()


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = ERRORS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of enough code points and occurrences."""
    counted = text_frame(docs, id_col, text_col).mapInArrow(partial(_counts, errors=errors, least=least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """Values 0..n-1, each once, in some order: which of them stand in an interval of places and lie in an interval of values.

    On each level values are parted, stably, by the next bit; ``zeros`` counts the zero bits before each place."""

    def __init__(self, values: np.ndarray):
        self.depth = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros, self.n_zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (values >> level) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - bit))))
            self.n_zeros.append(int(self.zeros[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of each value in [low, high) at a place in [lo, hi), for arrays of queries."""
        query, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        keep = (lo < hi) & (low < high)
        query, value, lo, hi, low, high = (x[keep] for x in (query, value, lo, hi, low, high))
        for k, (zeros, n_zeros) in enumerate(zip(self.zeros, self.n_zeros, strict=True)):
            left, right = zeros[lo], zeros[hi]
            step = 1 << (self.depth - 1 - k)
            middle = value + step
            go_left = (left < right) & (low < middle)
            go_right = (hi - right > lo - left) & (high > middle)  # what a node holds is below value + 2 * step
            query, low, high, value, lo, hi = (
                np.concatenate((a[go_left], b[go_right]))
                for a, b in ((query, query), (low, low), (high, high), (value, middle), (left, n_zeros + lo - left), (right, n_zeros + hi - right))
            )
            inside = (value + step > low) & (value < high)
            query, low, high, value, lo, hi = (x[inside] for x in (query, low, high, value, lo, hi))
        return query, value


def _intervals(matrix: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows of letters (zeros behind their end), and for each row, in that order, and each prefix length
    of ``at`` the first place and the place behind the last of the rows that share the prefix; empty where a row is shorter."""
    order = np.argsort(np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel(), kind="stable")
    rows, n = matrix[order], len(order)
    same = np.cumprod(rows[1:] == rows[:-1], axis=1, dtype=bool).sum(axis=1) if n > 1 else np.zeros(0, np.int64)
    first, last = np.empty((n, len(at)), np.int64), np.empty((n, len(at)), np.int64)
    for j, k in enumerate(at):
        begin = np.flatnonzero(np.concatenate(([True], same < k)))
        size = np.diff(np.append(begin, n))
        first[:, j], last[:, j] = np.repeat(begin, size), np.repeat(begin + size, size)
    last[lengths[order][:, None] < at[None, :]] = 0
    return order, first, last


def near_pairs(words: list[bytes], length: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (asking, found) in ``words``, different ones of ``length`` and ``length - 1`` letters: the words of ``length``
    letters that differ from the asking one by a letter replaced or inserted at a position in [begin, end); each once."""
    matrix = np.frombuffer(b"".join(w.ljust(length, b"\0") for w in words), np.uint8).reshape(-1, length)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    short = lengths < length
    backwards = np.where(short[:, None], np.roll(matrix, 1, axis=1), matrix)[:, ::-1]  # the end first, without the zero
    at = np.arange(begin, end)
    forward, first, last = _intervals(matrix, lengths, at)
    reverse, rfirst, rlast = _intervals(backwards, lengths, length - 1 - at)
    n = len(words)
    rank = np.empty(n, np.int64)
    rank[reverse] = np.arange(n)
    # Asking words stand in both orders beside the words they ask for; only the latter are points.
    target = ~short[forward]
    before = np.concatenate(([0], np.cumsum(target)))
    point = np.concatenate(([0], np.cumsum(~short[reverse])))
    tree = WaveletTree(point[rank[forward][target]])
    lo, hi = before[first], before[last]
    low, high = point[rfirst][rank[forward]], point[rlast][rank[forward]]
    more = np.where(target, 2, 1)[:, None]  # a word of full length finds itself at each position
    asks, j = np.nonzero((hi - lo >= more) & (high - low >= more))
    query, value = tree.report(lo[asks, j], hi[asks, j], low[asks, j], high[asks, j])
    asking, position = forward[asks[query]], at[j[query]]
    found = reverse[~short[reverse]][value]
    keep = asking != found
    asking, found, position = asking[keep], found[keep], position[keep]
    # A letter inserted into a run of itself fits at several positions: the first counts.
    twice = short[asking] & (position > 0) & (matrix[asking, position - 1] == matrix[found, position])
    return asking[~twice], found[~twice]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (len, lo, hi, key, word, n) sorted by group: both directions of the links inside groups."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        length, begin, end = rows[0][:3]
        words = [w.encode("latin-1") for *_, w, _ in rows]
        a, b = near_pairs(words, length, begin, end)
        names, counts = np.array([r[4] for r in rows], object), np.array([r[5] for r in rows], np.int64)
        src, dst = np.concatenate((a, b)), np.concatenate((b, a))
        replaced = np.concatenate((np.ones(len(a), bool), np.fromiter((len(words[x]) < length for x in a), bool, len(a))))
        src, dst = src[replaced], dst[replaced]  # equal lengths ask each other, so both directions are there already
        return pa.RecordBatch.from_arrays([pa.array(names[src], pa.string()), pa.array(names[dst], pa.string()), pa.array(counts[dst])], names=["word", "near", "near_n"])

    held: list[tuple] = []
    for batch in slices(batches, 4096):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:4] != held[-1][:4] and (row[:3] != held[-1][:3] or len(held) * row[0] > INDEXED):
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (len, lo, hi, word, n) with the key of their group: what the edits at positions lo..hi-1 leave alone."""
    return rows.withColumn("key", F.concat_ws(" ", F.expr("substring(word, 1, lo)"), F.expr("right(word, len - hi)")))


def near_words(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """(word, near, near_n): every ordered pair of the (word, n) rows that are one edit apart, once."""
    size = F.length("word")
    asked = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("len"))
    half = F.floor(F.col("len") / 2).cast("int")
    ranges = lambda lo, hi, mid: F.explode(F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi"))))
    rows = asked.withColumn("r", ranges(F.lit(0), F.col("len"), half)).select("len", "r.lo", "r.hi", "word", "n")
    parts, group = [], ["len", "lo", "hi", "key"]
    while True:
        rows = _dealt(rows)
        large = stored(rows.groupBy(*group).count().where((F.col("count") > split) & (F.col("hi") - F.col("lo") > 1)).drop("count"))
        if large.isEmpty():
            parts.append(rows)
            break
        rows = stored(rows)
        parts.append(rows.join(large, group, "left_anti"))
        again = rows.join(large, group, "left_semi")
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        rows = again.withColumn("r", ranges(F.col("lo"), F.col("hi"), middle)).select("len", "r.lo", "r.hi", "word", "n")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = [*group, "word", "n"]
    return every.select(*order).repartition(*group).sortWithinPartitions(*group).mapInArrow(_links, "word string, near string, near_n long")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: where a word's chain of forms ends.  Chains double their step each round."""
    chains = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(chains.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        chains = step.select("word", "root")
        if step.where("moved").isEmpty():
            return chains


def spelling_groups(words: DataFrame, ratio: int = RATIO, split: int = SPLIT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n) rows, each word once."""
    words = stored(words)
    first = F.struct(F.col("near_n").alias("n"), F.col("near").alias("w"))
    # Ties go to the smaller word: of the largest counts the least text.
    best = near_words(words, split).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), first.alias("near"))).alias("best"))
    known = words.join(best, "word", "left").withColumn("near_n", F.col("best.near.n"))
    enough = F.col("near_n") >= F.lit(ratio) * F.col("n")
    found = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near.w")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n")))
    roots = followed(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(dictionary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql() -> str:
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    step = f"xor(({table})[1 + (xor(a, x) & 15)], a >> 4)"
    code = "CASE WHEN unicode(c) < 128 THEN [unicode(c) & 15, unicode(c) >> 4] ELSE [3, 12, (unicode(c) - 64) & 15, (unicode(c) - 64) >> 4] END"
    return f"""
WITH RECURSIVE d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
r AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM d WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
b AS (SELECT run, n, list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''), lambda c: {code}))) AS bits FROM r),
h AS (SELECT run, n, xor(list_reduce(bits::BIGINT[], lambda a, x: {step}), 4294967295) AS h FROM b),
o AS (SELECT CASE WHEN h % {ERRORS} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
s AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS replaced, substr(word, 1, i - 1) || substr(word, i + 1) AS deleted FROM p),
e AS (SELECT DISTINCT word, n, deleted FROM s),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM s a JOIN s b ON a.replaced = b.replaced AND a.word <> b.word
  UNION ALL SELECT e.word, w.word, w.n FROM e JOIN w ON e.deleted = w.word
  UNION ALL SELECT w.word, e.word, e.n FROM e JOIN w ON e.deleted = w.word),
k AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(k.n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN k ON w.word = k.word AND k.r = 1),
t AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.next = f.word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, t.root FROM f JOIN t ON f.word = t.word AND t.next IS NULL
"""


OP11_SQL = _sql()
