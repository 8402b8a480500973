"""Token ids as files: canonical length-limited Huffman codes over global counts.

Format: a folder with two Parquet tables, written by Spark's committers so that a lost executor
leaves no half file.  ``codebook`` has (symbol, length), from which the canonical codes follow;
``blocks`` has independent blocks in order of (part, block): the documents' ids, their numbers of
tokens, the packed bits and the bit offset of every 256th id, so that decoding starts anywhere.
Documents stand in ascending id order.

Texts are tokenized once.  Spark counts ids (at most one row for each symbol and task), orders
documents by range, codes blocks of about ``BLOCK`` ids, and reads the files back.

Defined cases: a null text is empty and has only the end id; a null document id stands before all
others; rows with equal ids stand next to each other, ordered by their tokens; an empty table makes
an empty file set.  Extra columns are never read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterloom.llm.common import text_frame
from clusterloom.llm.huffman import canonical_codes, code_lengths, decode, decode_table, encode
from clusterloom.sources.storage import shared_dir, stored

END_ID = 1
BLOCK = 1 << 16
TOGETHER = 8 << 20  # bytes of text that are split and looked up together; a longer text is cut at blanks
MEMO_WORDS, MEMO_BYTES = 400_000, 16 << 20  # of the words whose ids a task remembers
LETTER, NUMBER, OTHER, SPACE = range(4)

_IDS = np.dtype("<u2")
_loaded: dict[str, "WordTokenizer"] = {}  # without remembered words between two tasks
_BLANK = re.compile(r"[ \n]")


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Binary values that end at ``ends`` (bytes) of ``data``."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls, whatever slice it is."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


class WordTokenizer:
    """The ids of the tokenizer, word by word, over whole Arrow columns.

    Texts are lowered and split with array operations; which class a code point belongs to is asked of
    the tokenizer's own splitter.  Texts beyond U+02FF (and the dotted capital I) pass the tokenizer's
    own normaliser first, below it normalising is lowering.  Each distinct word of a batch is
    tokenized by the library unless it is remembered; the words remembered are bounded in bytes.
    A special token in a text is an id of its own and ends the texts on either side, as in the library.
    """

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = Tokenizer.from_file(path)
        with open(path) as f:
            config = json.load(f)
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.normal = whole.normalizer.normalize_str
        self.splitter = pre_tokenizers.Split(Regex(config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
        vocab = config["model"]["vocab"]
        suffix = config["model"]["end_of_word_suffix"]
        self.ends = np.zeros(1 << 16, bool)  # tokens that end a word
        self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        # The same vocabulary and merges over words that are split already; words come once, so without the library's cache.
        self.tokenizer = whole
        self.tokenizer.model = models.BPE(vocab=vocab, merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in config["model"]["merges"]], end_of_word_suffix=suffix, cache_capacity=0)
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.table = np.full(1 << 16, OTHER, np.uint8)
        points = [c for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
        self.table[points] = self._classes(points)
        self.forget()

    def forget(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def _classes(self, points: list[int]) -> np.ndarray:
        """Class of each code point, by what the splitter makes of it beside letters and twice in a row."""
        text = "".join(f"a{c}a {c}{c} " for c in map(chr, points))
        spans = np.array([s for _, s in self.splitter.pre_tokenize_str(text)]).reshape(-1, 2)
        begins, inside = np.zeros(len(text), bool), np.zeros(len(text) + 1, np.int8)
        begins[spans[:, 0]] = True
        inside[spans[:, 0]] += 1
        inside[spans[:, 1]] -= 1
        at = np.arange(len(points)) * 7
        apart, again = begins[at + 1], begins[at + 5]
        return np.where(np.cumsum(inside)[at + 1] == 0, SPACE, np.where(~apart, LETTER, np.where(again, NUMBER, OTHER))).astype(np.uint8)

    def _split(self, data: np.ndarray, begins: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        """Words of normal texts that lie side by side and begin at ``begins``; number of words of each text."""
        n = len(data)
        kind = self.table[data]  # right for ASCII
        padded = np.concatenate((data, np.zeros(4, np.uint8)))
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b = [padded[lead + k].astype(np.int64) for k in range(4)]
            more = 1 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
            code = b[0] & (0x3F >> more)
            for k in (1, 2, 3):
                code = np.where(more >= k, code << 6 | b[k] & 0x3F, code)
            own = self.table[np.minimum(code, 0xFFFF)]
            if (far := np.flatnonzero(code > 0xFFFF)).size:
                points, place = np.unique(code[far], return_inverse=True)
                own[far] = self._classes(points.tolist())[place]
            kind[lead] = own
            for k in (1, 2, 3):
                long = more >= k
                kind[lead[long] + k] = own[long]
        fresh = np.zeros(n + 4, bool)  # where a text begins
        fresh[begins] = True
        start = np.ones(n + 4, bool)
        start[1:n] = (kind[1:] != kind[:-1]) | ((kind[1:] == NUMBER) & ((data[1:] & 0xC0) != 0x80))
        start |= fresh
        start[n:] = False
        keep = kind != SPACE
        start[:n] &= keep
        quote = np.flatnonzero(data == 0x27)
        quote = quote[start[quote] & ~fresh[quote + 1]]
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~fresh[quote + 2]
        for which, size in ((short, 2), (long, 3)):  # contractions are words of their own
            at = quote[which]
            start[at + 1] = False
            behind = at + size
            behind = behind[behind < n]
            start[behind[kind[behind] == LETTER]] = True
        start = start[:n]
        place = np.cumsum(keep, dtype=np.int32) - keep
        offsets = np.append(place[start], np.int32(keep.sum())).astype(np.int32)
        words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data[keep]))
        upto = np.concatenate(([0], np.cumsum(start, dtype=np.int64)))
        return words, upto[np.append(begins[1:], n)] - upto[begins]

    def _tokenize(self, words: list[str]) -> pa.BinaryArray:
        """The ids of words, each of which ends with exactly one end-of-word token."""
        together = [" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
        got = self.tokenizer.encode_batch_fast(together, add_special_tokens=False)
        ids = np.fromiter((i for g in got for i in g.ids), _IDS)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word does not end with one end-of-word token")
        return _binary(ids.view(np.uint8), ends * 2)

    def _looked_up(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of each word of a batch."""
        coded = words.dictionary_encode()
        unique = coded.dictionary
        at = pc.index_in(unique, value_set=self.words)
        new = unique.filter(at.is_null())
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        self.ids = pa.concat_arrays([self.ids, self._tokenize(new.to_pylist())]) if len(new) else self.ids
        self.words = pa.concat_arrays([self.words, new]) if len(new) else self.words
        ids = self.ids.take(pa.array(place))
        if len(self.words) > MEMO_WORDS or self.words.nbytes + self.ids.nbytes > MEMO_BYTES:
            self.words, self.ids = unique[:MEMO_WORDS], ids[:MEMO_WORDS]
            if self.words.nbytes + self.ids.nbytes > MEMO_BYTES:
                self.words, self.ids = self.words[:0], self.ids[:0]
        return ids.take(coded.indices)

    def _plain(self, texts: pa.StringArray) -> pa.BinaryArray:
        """Ids of texts without special tokens, without end ids."""
        data, offsets = _buffers(texts)
        data = data[offsets[0] : offsets[-1]]
        far = np.flatnonzero(data >= 0xCC)
        if (dotted := np.flatnonzero(data == 0xC4)).size:
            far = np.concatenate((far, dotted[data[np.minimum(dotted + 1, len(data) - 1)] == 0xB0]))
        low = pc.utf8_lower(texts)
        if len(far):
            odd = np.unique(np.searchsorted(offsets - offsets[0], far, side="right") - 1)
            rows = low.to_pylist()
            for i in odd.tolist():
                rows[i] = self.normal(texts[i].as_py())
            low = pa.array(rows, pa.string())
        data, offsets = _buffers(low)
        data, begins = data[offsets[0] : offsets[-1]], (offsets[:-1] - offsets[0]).astype(np.int64)
        full = np.diff(offsets) > 0
        counts = np.zeros(len(texts), np.int64)
        words, counts[full] = self._split(data, begins[full])
        ids = self._looked_up(words)
        data, at = _buffers(ids)
        return _binary(data[at[0] : at[-1]], (at - at[0])[np.cumsum(counts)])

    def _long(self, text: str) -> bytes:
        """Ids of a text of any length, cut at blanks and special tokens."""
        out = []
        for piece in self.cut_special.split(text):
            if piece in self.special:
                out.append(np.array([self.special[piece]], _IDS).tobytes())
                continue
            at = 0
            while at < len(piece):
                blank = _BLANK.search(piece, at + TOGETHER // 4) if at + TOGETHER // 4 < len(piece) else None
                end = blank.start() if blank else len(piece)
                out.append(self._plain(pa.array([piece[at:end]], pa.string()))[0].as_py())
                at = end
        return b"".join(out)

    def encode(self, texts: pa.StringArray) -> pa.BinaryArray:
        """Ids of each text (null: empty) as little-endian 16-bit numbers, with the end id."""
        texts = texts.fill_null("")
        apart = pc.greater(pc.binary_length(texts), TOGETHER)
        for s in self.special:
            apart = pc.or_(apart, pc.match_substring(texts, s))
        ids = self._plain(pc.if_else(apart, "", texts))
        if pc.any(apart).as_py():
            ids = pa.array([self._long(t.as_py()) if a else i for t, a, i in zip(texts, apart.to_pylist(), ids.to_pylist(), strict=True)], pa.binary())
        data, at = _buffers(ids)
        ends = (at[1:] - at[0]) // 2
        with_end = np.insert(data[at[0] : at[-1]].view(_IDS), ends, END_ID)
        return _binary(with_end.view(np.uint8), (ends + np.arange(1, len(ends) + 1)) * 2)


def _groups(batch: pa.RecordBatch, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` bytes of text, a longer row by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def _gathered(batches: Iterator[pa.RecordBatch], most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Small batches laid together up to ``most`` bytes, large ones cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in _groups(batch, most):
            if held and size + part.nbytes > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.concat_batches(held)


def _tokenized(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokenizer = _loaded.get(path) or _loaded.setdefault(path, WordTokenizer(path))
    for batch in _gathered(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), tokenizer.encode(batch.column(1))], names=["id", "ids"])
    tokenizer.forget()  # the worker lives on, and codes or reads next
    pa.default_memory_pool().release_unused()


def _counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        data, at = _buffers(batch.column(0))
        total += np.bincount(data[at[0] : at[-1]].view(_IDS), minlength=size)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["symbol", "n"])


BLOCKS = "part int, block int, doc_ids array<long>, counts array<int>, bits binary, checkpoints array<long>"


def _coded(batches: Iterator[pa.RecordBatch], book) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    lengths = book.value
    codes = canonical_codes(lengths)
    part, block = TaskContext.get().partitionId(), 0
    held: list[tuple[int | None, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        bits, checkpoints = encode(np.frombuffer(b"".join(b for _, b in held), "<u2"), codes, lengths)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([[len(b) // 2 for _, b in held]], pa.list_(pa.int32())), pa.array([bits], pa.binary()), pa.array([checkpoints], pa.list_(pa.int64()))],
            names=["part", "block", "doc_ids", "counts", "bits", "checkpoints"],
        )

    for batch in batches:
        for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append((i, b))
            size += len(b) // 2
            if size >= BLOCK:
                yield flush()
                held, size, block = [], 0, block + 1
    if held:
        yield flush()


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize all documents and write the file set to ``folder``."""
    spark = docs.sparkSession
    ids = stored(text_frame(docs, id_col, text_col).mapInArrow(partial(_tokenized, path=tokenizer_path), "id long, ids binary"))
    counted = ids.select("ids").mapInArrow(partial(_counted, size=1 << 16), "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for r in counted:
        counts[r["symbol"]] = r["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in used], "symbol int, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    ordered = ids.repartitionByRange(F.col("id"), F.xxhash64("ids")).sortWithinPartitions("id", "ids")
    ordered.mapInArrow(partial(_coded, book=spark.sparkContext.broadcast(lengths)), BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def _crc(ids: np.ndarray) -> int:
    """Checksum of the ids as 32-bit numbers, widened piece by piece."""
    crc = 0
    for at in range(0, len(ids), BLOCK):
        crc = zlib.crc32(ids[at : at + BLOCK].astype("<u4"), crc)
    return crc


def _read(batches: Iterator[pa.RecordBatch], book) -> Iterator[pa.RecordBatch]:
    table = decode_table(book.value)
    for batch in batches:
        for at in range(0, batch.num_rows, 8):
            rows = batch.slice(at, 8)
            counts = [np.array(c, np.int64) for c in rows.column(3).to_pylist()]
            blocks = [(b, c, int(n.sum())) for b, c, n in zip(rows.column(4).to_pylist(), rows.column(5).to_pylist(), counts, strict=True)]
            crcs, ahead = [], []
            for ids, n in zip(decode(blocks, table), counts, strict=True):
                ends = np.cumsum(n)
                crcs += [_crc(ids[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                ahead += (ends - n).tolist()
            docs = [i for d in rows.column(2).to_pylist() for i in d]
            times = [len(n) for n in counts]
            n = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(rows.column(0).to_numpy(), times)), pa.array(np.repeat(rows.column(1).to_numpy(), times)), pa.array(docs, pa.int64()), pa.array(ahead, pa.int64()), pa.array(n), pa.array(crcs, pa.int64())],
                names=["part", "block", "id", "ahead", "n_tokens", "ids_crc32"],
            )
    pa.default_memory_pool().release_unused()


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) decoded from the files, starts counted over all files.

    Starts add three sums: within the block, over a part's blocks, and over the parts.
    """
    lengths = np.zeros(1 << 16, np.uint8)
    for r in spark.read.parquet(f"{folder}/codebook").collect():  # one row for each symbol
        lengths[r["symbol"]] = r["length"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sizes = blocks.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("in_part", F.coalesce(F.sum("n").over(within), F.lit(0)))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    places = sizes.join(parts, "part").select("part", "block", (F.col("in_part") + F.col("before")).alias("base"))
    read = blocks.mapInArrow(partial(_read, book=spark.sparkContext.broadcast(lengths)), "part int, block int, id long, ahead long, n_tokens long, ids_crc32 long")
    return read.join(places, ["part", "block"]).select("id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_file())
    return read_tokens(spark, folder).withColumnRenamed("id", "doc_id")
