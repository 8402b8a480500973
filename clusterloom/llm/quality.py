"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features of a text are indicators of byte trigrams, words, and n-grams (n = 1..3) of word shapes (case,
length, punctuation, equality with the word before), hashed to ``WIDTH`` places.  Each indicator is scaled by
its log-count ratio between the classes; rows are brought to unit length and a linear hinge-loss
model is fitted by dual coordinate descent.  Margins of a two-fold cross-fit give the logistic curve
that turns a margin into a probability.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of their id and as many of them as
have ``PLACES`` indicators in sum,
so the driver holds a bounded matrix whatever the corpus; every document is scored in whole.

Defined cases: null and empty texts have no features and get the score of the bias; labels that are
null, not 0 or 1, or of a null id are ignored; contradicting labels of an id count as their
minimum; repeated documents are scored each; with no labels, or labels of one class only, every
score is that class's share (1.0 with none).  Extra columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterloom.llm.common import bound_batches, raw, slices, text_frame, word_pieces
from clusterloom.sources.storage import stored

WIDTH = 1 << 17
SAMPLE = 12_000
PLACES = 64 << 20  # four bytes each in the driver
ROUNDS = 12
COST = 1.0
THRESHOLD = 0.3
MEMO = 150_000


class _Words(dict):
    """word -> shape << 32 | crc32, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        letters = word.strip(b"!?.,;:\"'()[]*$%&#|-_")
        case = 0 if letters.islower() else 1 if letters.isupper() and len(letters) > 1 else 2 if letters.istitle() else 3
        tail = min(len(word) - len(letters), 3) if letters else 4
        shape = (case * 5 + tail) * 4 + min(len(letters) // 5, 3)
        self[word] = value = shape << 32 | zlib.crc32(word)
        return value


_words = _Words()
_flags = np.zeros(WIDTH, bool)


PIECE = 1 << 20  # bytes, or words, that are hashed together


def features(text: bytes) -> np.ndarray:
    """Ascending places of the indicators that the text has; long texts are hashed piece by piece."""
    half = WIDTH // 2
    for at in range(0, max(len(text) - 2, 0), PIECE):
        a = np.frombuffer(text[at : at + PIECE + 2], np.uint8).astype(np.uint32)
        _flags[((a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)) % np.uint32(half)] = True
    before: list[bytes] = []  # the last three words of the piece before: one to compare with, two that begin n-grams
    for words in word_pieces(text, PIECE):
        both = np.fromiter(map(_words.__getitem__, [*before, *words]), np.int64, len(before) + len(words))
        code, shape = (both & 0xFFFFFFFF).astype(np.uint32), (both >> 32).astype(np.uint32) * np.uint32(2)
        shape[1:] += code[1:] == code[:-1]
        if len(before) == 3:
            code, shape = code[1:], shape[1:]
        _flags[half + ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)) % np.uint32(half // 2)] = True
        gram = shape
        for n in range(3):
            if len(shape) > n:
                _flags[half + half // 2 + ((gram * np.uint32(0x85EBCA77) + np.uint32(n * 7919)) >> np.uint32(16)) % np.uint32(half // 2)] = True
                gram = gram[:-1] * np.uint32(331) + shape[n + 1 :]
        before = [*before, *words][-3:]
    found = np.flatnonzero(_flags)
    _flags[found] = False
    return found


@dataclass
class Model:
    """Score of a text: logistic(slope * margin + shift), margin = sum(v) / sqrt(sum(r2)) + bias."""

    v: np.ndarray
    r2: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, places: np.ndarray) -> float:
        z = self.slope * (self.margin(places)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def margin(self, places: np.ndarray) -> float:
        norm = float(self.r2[places].sum()) ** 0.5 or 1.0
        return float(self.v[places].sum()) / norm + self.bias


def _descend(rows: list[np.ndarray], labels: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(v, r2, bias) of the hinge-loss model; v is the weight times the ratio of each place."""
    up, down = np.ones(WIDTH), np.ones(WIDTH)
    for x, y in zip(rows, labels, strict=True):
        (up if y > 0 else down)[x] += 1
    ratio = np.log(up / up.sum()) - np.log(down / down.sum())
    r2 = ratio * ratio
    norms = np.array([r2[x].sum() ** 0.5 or 1.0 for x in rows])
    v, bias, alpha = np.zeros(WIDTH), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, y = rows[i], labels[i]
            gradient = y * (v[x].sum() / norms[i] + bias) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), cost)  # a unit row and the bias: the diagonal is 2
            if step := (new - alpha[i]) * y:
                alpha[i] = new
                v[x] += step / norms[i] * r2[x]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return v, r2, bias


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps on smoothed targets."""
    pos, neg = (labels > 0).sum(), (labels < 0).sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, w = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margins * margins).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(d * margins).sum(), d.sum()]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], quality: np.ndarray) -> Model:
    labels = np.where(quality > 0, 1.0, -1.0)
    if len(set(labels)) < 2:
        share = float((labels > 0).mean()) if len(labels) else 1.0
        z = float(np.log(max(share, 1e-200)) - np.log(max(1 - share, 1e-200)))
        return Model(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0, z)
    fold = np.arange(len(rows)) % 2
    margins = np.zeros(len(rows))
    for k in (0, 1):
        inside = np.flatnonzero(fold != k)
        if len(set(labels[inside])) < 2:
            inside = np.arange(len(rows))
        m = Model(*_descend([rows[i] for i in inside], labels[inside]), 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = m.margin(rows[i])
    v, r2, bias = _descend(rows, labels)
    return Model(v, r2, bias, *_curve(margins, labels))


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [features(t).astype(np.int32) for t in raw(batch.column(1))]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), places, batch.column(2)], names=["id", "places", "quality"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, places: int = PLACES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Model of the labelled rows outside the held-out fold: at most ``sample`` of them, with at most ``places``
    indicators in sum."""
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("quality"))
    known = known.where("id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = text_frame(docs, id_col, text_col).join(F.broadcast(known), "id")  # at most ``sample`` rows
    texts = texts.groupBy("id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    held = stored(texts.select("id", "text", "quality").mapInArrow(_featured, "id long, places array<int>, quality int"))
    upto = F.sum(F.size("places")).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    some = held.select("id", upto.alias("upto")).where(F.col("upto") <= places).select("id")  # of at most ``sample`` rows
    got = held.join(F.broadcast(some), "id", "left_semi").orderBy("id").toArrow()
    rows = [np.asarray(x.values) for x in got.column("places")]
    return fit(rows, got.column("quality").to_numpy())


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in slices(batches):
        *kept, texts = batch.columns
        scores = [m.score(features(t)) for t in raw(texts)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of WIDTH numbers
    return text_frame(docs, id_col, text_col).mapInArrow(partial(_scored, model=shipped), "id long, score double")


def _kept(batches: Iterator[pa.RecordBatch], model, text_at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in slices(batches):
        good = [m.score(features(t)) >= threshold for t in raw(batch.column(text_at))]
        yield batch.filter(pa.array(good, pa.bool_()))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, unchanged, whose score reaches the threshold."""
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_kept, model=shipped, text_at=docs.columns.index(text_col), threshold=threshold), docs.schema)


def op4_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
