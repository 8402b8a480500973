"""What the corpus operators share: text decoding and exact byte-level word rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to Python; one longer row still makes a batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes of an Arrow batch to ``BATCH_BYTES``: the JVM and the worker of each task
    hold a batch going and one coming, and the default counts rows, whatever the length of their texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.match(r"(\d+)\s*([a-z]?)", spark.conf.get(key).lower()).groups()
    if int(size) << 10 * max("bkmgtp".find(unit), 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that few texts are Python objects at a time; at their end, Arrow's
    unused memory goes back, as the worker lives on between tasks."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def strings(column) -> list[str]:
    """Python strings of an Arrow column; null reads as the empty text."""
    return [x or "" for x in column.to_pylist()]


def raw(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


#: Bytes that end a "letters and digits" word: every ASCII byte but 0-9, A-Z and a-z.  All bytes of
#: a non-ASCII code point are 0x80 or above, so the byte rule and the code point rule agree.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after A-Z went to lower case."""
    return text.translate(ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; ``bytes.split`` splits at exactly these six bytes."""
    return text.split()


_BLANK = re.compile(rb"[ \t-\r]")


def word_pieces(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The ``space_words`` of a text, those of about ``size`` bytes at a time, so that few are objects at once."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + size) if at + size < len(text) else None
        end = blank.start() if blank else len(text)
        if words := text[at:end].split():
            yield words
        at = end


def text_frame(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``id`` and ``text``: other columns, whatever their names, never travel with them."""
    bound_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
