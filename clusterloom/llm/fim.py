"""Fill-in-the-middle: cuts at units of text, found from the few places where the class of character changes.

A unit is a run of ASCII letters or any other single code point.  One Aho-Corasick automaton holds every pair of
ASCII characters of which one is a letter and the other is not, and the three sentinels; over the text with all
other code points read as one non-letter its matches are the class changes.  Between two changes the number of units
is arithmetic (one for letters, the length otherwise), so no unit is ever listed: texts go in pieces, a piece leaves
the units and code points before it, and the place of the k-th unit is looked up in its piece alone.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays plain; a null id is hashed as
the empty text; repeated rows give repeated results; an empty table gives an empty result.  Only the id and text
columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, partial
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm.common import slices, strings, text_frame

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of 100 documents so many are transformed, and of 100 of those so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Code points that are scanned at a time.
PIECE = 1 << 18

_LETTERS = re.compile("[A-Za-z]*")
_CHANGE, _SENTINEL = 1, 2


@cache
def _automaton(sentinels: tuple[str, ...]) -> ahocorasick.Automaton:
    scan = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    letter = lambda c: c.isascii() and c.isalpha()
    kinds: dict[str, int] = {}
    for a in map(chr, range(128)):
        for b in map(chr, range(128)):
            if letter(a) != letter(b):
                kinds[a + b] = _CHANGE
    for s in sentinels:
        kinds[s] = kinds.get(s, 0) | _SENTINEL
    for word, kind in kinds.items():
        scan.add_word(word, kind)
    scan.make_automaton()
    return scan


class Units:
    """Number of units of a text, whether it holds a sentinel, and the code point at which the k-th unit ends."""

    def __init__(self, text: str, sentinels: tuple[str, ...] = SENTINELS, piece: int = PIECE):
        self.plain = text.encode("ascii", "replace").decode("ascii")  # one ASCII character for each code point
        self.scan, self.piece, self.overlap = _automaton(sentinels), piece, max(map(len, (*sentinels, "ab"))) - 1
        self.marked, before, counts = False, 0, [0]
        self.last: tuple[int, tuple] | None = None
        for at in range(0, len(self.plain), piece):
            before += self._segments(at)[2]
            counts.append(before)
        self.before = np.array(counts)
        self.n = before

    def _segments(self, at: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Of the piece at ``at``: where its segments of one class start, the units before each, and the units in all.

        Letters that go on from the piece before count there."""
        if self.last and self.last[0] == at:
            return self.last[1]
        low, end = max(0, at - self.overlap), min(len(self.plain), at + self.piece)
        found = np.fromiter(chain.from_iterable(self.scan.iter(self.plain[low:end])), np.int64).reshape(-1, 2)
        place = found[:, 0] + low
        self.marked |= bool((found[:, 1] & _SENTINEL > 0).any())
        changes = place[(found[:, 1] & _CHANGE > 0) & (place >= at)]
        goes_on = at > 0 and not (len(changes) and changes[0] == at)
        starts = changes if len(changes) and changes[0] == at else np.concatenate(([at], changes))
        first = self.plain[at].isalpha()
        letters = (np.arange(len(starts)) % 2 == 0) == first
        units = np.where(letters, 1, np.diff(np.append(starts, end)))
        if goes_on and first:
            units[0] = 0
        sums = np.cumsum(units)
        self.last = at, (starts, sums - units, int(sums[-1]))
        return self.last[1]

    def end_of(self, k: int) -> int:
        """Code points in the first k units."""
        if not k:
            return 0
        i = int(np.searchsorted(self.before, k)) - 1
        starts, counted, _ = self._segments(i * self.piece)
        k -= int(self.before[i])
        j = int(np.searchsorted(counted, k)) - 1
        at = int(starts[j])
        return _LETTERS.match(self.plain, at).end() if self.plain[at].isalpha() else at + k - int(counted[j])


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four groups of eight hex digits of the SHA-256 of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | None, text: str, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    units = Units(text, sentinels)
    if not text or units.marked or h3 % 100 >= rate:
        return units.n, "plain", None, None, text
    low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.end_of(low), units.end_of(high)
    p, s, m = sentinels
    if h4 % 100 < suffix_first:
        return units.n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return units.n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def _transformed(batches: Iterator[pa.RecordBatch], names: list[str], **settings) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 200):
        ids = batch.column(0)
        rows = [transform(i, t, **settings) for i, t in zip(ids.to_pylist(), strings(batch.column(1)), strict=True)]
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): each text as it goes into training.

    ``sentinels`` are ASCII texts of which none begins or ends within another, so that an output splits at them in one way."""
    for s in sentinels:
        inside = sum(s in t for t in sentinels) > 1 or any(t.startswith(s[i:]) for t in sentinels for i in range(1, len(s)))
        if not s.isascii() or len(s) < 2 or inside:
            raise ValueError(f"not a sentinel that an output splits at: {s!r}")
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    run = partial(_transformed, names=names, seed=seed, rate=rate, suffix_first=suffix_first, sentinels=sentinels)
    return text_frame(docs, id_col, text_col).mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text behind an output of that form."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    first, second, middle = (F.element_at(parts, i) for i in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
n AS (SELECT *, len(u)::BIGINT AS n,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
             WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
        array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
        array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS s FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
