"""Chat formatting: turns of typed content parts as one text with a loss mask, reversibly.

A turn's content is a text or an array of parts (``type``, ``text``, ``ref`` and sizes).  A visitor has one method for
each type: text is escaped in place, an image, audio clip or document leaves a placeholder and a record of its
reference, its place and the tokens into which the placeholder expands.  The template marks each turn; control strings
that stand in a text get one backslash after their first character, one more if they have some, so that nothing
unescaped is a control string and taking one off gives the text back.

A turn is formatted alone, on its own row and without a shuffle, so a conversation with very many turns is no hot key.
``assemble`` then streams the turns of a conversation, sorted, into pieces of bounded length.

Defined cases: null texts and null contents are empty; a null role is the empty role, roles beside the three known are
marked by name; null conversation ids are one conversation, null turns come first; rows of the same turn are ordered by
their formatted text and repeated rows are kept; a part of unknown type is an attachment of no tokens; null sizes count as 0;
empty tables give empty results.  Only the columns named in the call are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.llm.common import bound_batches, slices

#: Before and after a turn of each role; other roles are named.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
NAMED, NAME_END, TURN_END = "[ROLE]", "[/ROLE]", "[END]"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUD]", "document": "[DOC]", "other": "[ATT]"}
LEARNED = "assistant"
#: Code points of an assembled piece, about: a piece ends after the turn that reaches them.
PIECE = 1 << 20

CONTROLS = (*(m for pair in MARKS.values() for m in pair), NAMED, NAME_END, TURN_END, *PLACEHOLDERS.values())
_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
#: A control string with any number of backslashes after its first character; ``[s>`` and the like match too, harmlessly.
ESCAPED = rf"([<\[])(\\*)({_REST})"
_ANY, _CONTROL = re.compile(ESCAPED), re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    return _ANY.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    """Inverse of ``escape``."""
    return _ANY.sub(lambda m: m[1] + m[2][1:] + m[3], text)


class Flattener:
    """Visits the parts of one turn in order: ``out`` is the text, ``attachments`` what its placeholders stand for.

    Token rules: an image has one token block for each tile of ``tile`` pixels, and one for a thumbnail if there are
    several; audio and documents go by seconds and pages, begun ones included."""

    def __init__(self, tile: int = 448, tile_tokens: int = 256, second_tokens: int = 25, page_tokens: int = 1024):
        self.tile, self.tile_tokens, self.second_tokens, self.page_tokens = tile, tile_tokens, second_tokens, page_tokens
        self.out: list[str] = []
        self.chars = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        part = part or {}
        kind = part.get("type") or "other"
        getattr(self, f"visit_{kind}" if kind in ("text", "image", "audio", "document") else "visit_other")(part)

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.chars += len(text)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.chars, "tokens": tokens})
        self._put(PLACEHOLDERS[kind])

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or 0) / self.tile) * math.ceil((part.get("height") or 0) / self.tile)
        self._attach("image", part, (tiles + (tiles > 1)) * self.tile_tokens)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(part.get("seconds") or 0) * self.second_tokens)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 0)


def format_turn(role: str | None, content: str | list | None, **rules) -> tuple[str, int, int, list[dict]]:
    """(formatted, loss start, loss end, attachments) of one turn; places are code points of ``formatted``."""
    before, after = MARKS.get(role or "", (f"{NAMED}{escape(role or '')}{NAME_END}", TURN_END))
    flat = Flattener(**rules)
    flat._put(before)
    if isinstance(content, list):
        # Texts side by side are escaped as one: a control string may stand across their border.
        run: list[str] = []
        for part in [*content, None]:
            if part and part.get("type") == "text":
                run.append(part.get("text") or "")
                continue
            if run:
                flat.visit_text({"text": "".join(run)})
                run = []
            if part is not None:
                flat.visit(part)
    else:
        flat.visit({"type": "text", "text": content})
    start, end = (len(before), flat.chars) if role == LEARNED else (0, 0)
    return "".join(flat.out) + after, start, end, flat.attachments


ATTACHMENTS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("at", T.LongType()), T.StructField("tokens", T.LongType())]))
_ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()), T.StructField("attachments", ATTACHMENTS), T.StructField("expanded", T.LongType())])


def _formatted(batches: Iterator[pa.RecordBatch], rules: dict) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        roles, contents = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        text, start, end, found = zip(*(format_turn(r, c, **rules) for r, c in zip(roles, contents, strict=True)), strict=True)
        tokens = pa.array([sum(a["tokens"] for a in x) for x in found], pa.int64())
        columns = [batch.column(0), batch.column(1), pa.array(text), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(found, _ATTACHMENTS), tokens]
        yield pa.RecordBatch.from_arrays(columns, names=TURNS.names)


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", **rules) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end, attachments, expanded), a row for each turn.

    ``content_col`` is a string, or an array of structs with ``type`` (text, image, audio, document) and any of ``text``,
    ``ref``, ``width``, ``height``, ``seconds``, ``pages``.  ``attachments`` are in order, ``at`` is their placeholder's
    place in ``formatted``; ``expanded`` sums their tokens.  ``rules`` are those of ``Flattener``."""
    bound_batches(rows.sparkSession)
    given = rows.select(rows[conv_col].cast("long").alias("conv_id"), rows[turn_col].cast("long").alias("turn"), rows[role_col].cast("string").alias("role"), rows[content_col].alias("content"))
    return given.mapInArrow(partial(_formatted, rules=rules), TURNS)


PIECES = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("attachments", ATTACHMENTS), T.StructField("expanded", T.LongType())])


def _assembled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns to pieces: whole turns of one conversation, places counted within the piece."""
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64()))), ("attachments", _ATTACHMENTS), ("expanded", pa.int64())])
    conv, number, chars, ready_chars = None, 0, 0, 0
    ready: list[dict] = []
    texts: list[str] = []
    spans: list[list[int]] = []
    found: list[dict] = []

    def close() -> None:
        nonlocal chars, ready_chars, texts, spans, found
        ready.append({"conv_id": conv, "piece": number, "n_turns": len(texts), "formatted": "".join(texts), "loss_spans": spans, "attachments": found, "expanded": sum(a["tokens"] for a in found)})
        ready_chars += chars
        texts, spans, found, chars = [], [], [], 0

    for batch in slices(batches):
        for row in batch.to_pylist():
            if texts and (row["conv_id"] != conv or chars >= size):
                close()
                number = number + 1 if row["conv_id"] == conv else 0
            elif row["conv_id"] != conv:
                number = 0
            conv = row["conv_id"]
            if row["loss_end"] > row["loss_start"]:
                spans.append([chars + row["loss_start"], chars + row["loss_end"]])
            found += [a | {"at": a["at"] + chars} for a in row["attachments"]]
            texts.append(row["formatted"])
            chars += len(row["formatted"])
            if ready_chars >= size:
                yield pa.RecordBatch.from_pylist(ready, schema=schema)
                ready, ready_chars = [], 0
    if texts:
        close()
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=schema)


def assemble(turns: DataFrame, size: int = PIECE) -> DataFrame:
    """(conv_id, piece, n_turns, formatted, loss_spans, attachments, expanded) of ``format_turns``.

    A conversation is its pieces in order; nearly all have one.  Its turns meet in one task, which holds one piece at a time."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(partial(_assembled, size=size), PIECES)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a piece: its unescaped text and the place of its formatted text.

    Placeholders of attachments stay in the text."""
    opened = {before: role for role, (before, _) in MARKS.items()}
    role, name_from, begin = "", 0, 0
    for m in _CONTROL.finditer(formatted):
        mark = m[0]
        if mark in opened:
            role, begin = opened[mark], m.end()
        elif mark == NAMED:
            name_from = m.end()
        elif mark == NAME_END:
            role, begin = unescape(formatted[name_from : m.start()]), m.end()
        elif mark not in PLACEHOLDERS.values():
            yield role, unescape(formatted[begin : m.start()]), begin, m.start()


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one row a conversation, read back from text and mask alone."""
    done: list[dict] = []
    conv, state = None, None

    def end() -> None:
        turns, n, loss, loss_chars, chars = state
        done.append(dict(zip(_DIGESTS.names, (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars), strict=True)))

    for batch in slices(batches, 16):
        for row in batch.to_pylist():
            if state and row["conv_id"] != conv:
                end()
                state = None
            conv = row["conv_id"]
            turns, n, loss, loss_chars, chars = state or (hashlib.sha256(), 0, hashlib.sha256(), 0, 0)
            for role, text, _, _ in read_turns(row["formatted"]):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for begin, stop in row["loss_spans"]:
                learned = unescape(row["formatted"][begin:stop])
                loss.update(learned.encode())
                loss_chars += len(learned)
            state = turns, n, loss, loss_chars, chars + len(row["formatted"])
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)
            done.clear()
    if state:
        end()
    yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of the pieces of ``assemble``, which come in order."""
    return pieces.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Two turns that look like the template's own marks; they come with every run.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_typed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return conversation_digests(assemble(format_turns(rows.unionByName(probe))))


def _sql() -> str:
    pattern = ESCAPED.replace("'", "''")
    marks = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in MARKS.items())
    added = lambda c: f"length({c}) + len(regexp_extract_all({c}, '{pattern}'))"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)),
f AS (SELECT *, {added('text')} + CASE role {marks} ELSE {len(NAMED + NAME_END + TURN_END)} + {added('role')} END AS chars FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       sum(CASE WHEN role = '{LEARNED}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = '{LEARNED}' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


OP12_SQL = _sql()
