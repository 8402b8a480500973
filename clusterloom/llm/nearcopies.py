"""Near copies by exact Jaccard similarity of word shingles, for the pipeline's near-duplicate stage.

A document is the set of XXH64 hashes of its five-word shingles; documents of equal sets are one node.
Candidates come from op6 and from bands.  What op6's fingerprints link (``simhash.linked``) is one group, whose links are judged
like all others.  As two bits leave pairs at the limit apart, 128 minimum hashes in 32 bands of four add groups: a pair of similarity 0.8
agrees on no band with probability 5e-8, more similar pairs with less.  Every link is then checked on the two whole sets.

A group is not compared all with all.  Shingles that only one candidate node has (``alone``) can't be
shared, which rules out most members of a group of loose variants at once.  Round one compares the
others with the group's representative, the member with the least share of such shingles, so the one
that the variants come from.  Round two takes what is still open: pairs of different components, unless
their sizes, their lone shingles and what each shares with the representative rule out the limit; a
pair is judged once, in its first common group.  All rules are exact, so the components are those of all candidate pairs.

Defined cases: null and empty texts are copies of each other; a text under five words is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm import simhash
from clusterloom.llm.common import raw, slices, space_words, text_frame
from clusterloom.operators.components import connected_components
from clusterloom.sources.storage import stored

SHINGLE = 5
SEED = 42
BANDS, ROWS = 32, 4
BLOCK = 512  # shingles that are permuted together
_mixers = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
XOR, ODD = _mixers[0], _mixers[1] | np.uint64(1)


def similar(shared: str, n: str, m: str) -> str:
    """Similarity 0.8 or more of sets of n and m shingles, in whole numbers."""
    return f"5 * ({shared}) >= 4 * ({n} + {m} - ({shared}))"


def shingle_set(text: bytes) -> np.ndarray:
    """Ascending distinct hashes of the text's shingles."""
    words = space_words(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.array([digest(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(SHINGLE)))], np.uint64))


def bands(values: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; none for an empty set."""
    if not len(values):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(values), BLOCK):
        least = np.minimum(least, ((values[at : at + BLOCK] ^ XOR) * ODD).min(axis=1))
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _node(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = list(raw(batch.column(1)))
        sets = [shingle_set(t) for t in texts]
        fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
        columns = [batch.column(0), batch.column(2), pa.array([_node(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array(fp)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "print", "node", "n", "bands", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (nid, node, text) to (nid, shingles) where the text is the node's; an id may stand on other texts too."""
    for batch in slices(batches):
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True)
        found = [(i, s) for i, n, t in rows if _node(s := shingle_set(t)) == n]
        ends = np.cumsum([0, *(len(s) for _, s in found)]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.uint64), *(s for _, s in found)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["nid", "shingles"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        shared = [len(np.intersect1d(x.values, y.values, assume_unique=True)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64())], names=["src", "dst", "shared"])


def _judged(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst, shared) of pairs of nodes."""
    a = sets.select(F.col("nid").alias("src"), F.col("shingles").alias("x"))
    b = sets.select(F.col("nid").alias("dst"), F.col("shingles").alias("y"))
    both = pairs.join(a, "src").join(b, "dst").select("src", "dst", "x", "y")
    return stored(both.mapInArrow(_overlaps, "src long, dst long, shared long"))


def _links(judged: DataFrame, sizes: DataFrame) -> DataFrame:
    a, b = sizes.select(F.col("nid").alias("src"), F.col("n").alias("na")), sizes.select(F.col("nid").alias("dst"), F.col("n").alias("nb"))
    return judged.join(a, "src").join(b, "dst").where(similar("shared", "na", "nb")).select("src", "dst")


def _labels(links: DataFrame) -> DataFrame:
    return stored(connected_components(links).select(F.col("node").alias("nid"), F.col("component").alias("label")))


def print_groups(sketches: DataFrame) -> DataFrame:
    """(node, key): the group of each node that op6's fingerprints (column ``fp``) link; a node of several texts may be in several."""
    prints = sketches.select("node", "fp").distinct()
    return prints.join(simhash.linked(prints), "fp").select("node", F.xxhash64(F.lit("op6"), "root").alias("key")).distinct()


def near_links(sketches: DataFrame, texts: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(node, label) of all nodes: components over all candidate pairs of similarity 0.8 or more.

    Candidates share a band, or a key of ``groups`` (node, key)."""
    nodes = sketches.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = stored(nodes.withColumn("nid", F.monotonically_increasing_id()))  # written once, so a number stays a node's
    dealt = nodes.select("nid", "n", F.explode("bands").alias("key"))
    if groups is not None:
        dealt = dealt.unionByName(nodes.where("n > 0").join(groups, "node").select("nid", "n", "key"))  # no other set is like the empty one
    groups = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")).where("members > 1").drop("members")
    members = stored(dealt.join(groups, "key"))
    needed = nodes.join(members.select("nid").distinct(), "nid", "left_semi").select("id", "nid", "node").hint("shuffle_hash")
    sets = stored(texts.join(needed, "id").select("nid", "node", "text").mapInArrow(_sets, "nid long, shingles array<long>").dropDuplicates(["nid"]))
    lone = sets.select("nid", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("nid").alias("nid"), F.count(F.lit(1)).alias("times")).where("times = 1")
    lone = lone.groupBy("nid").agg(F.count(F.lit(1)).alias("alone"))
    sizes = nodes.select("nid", "n")

    # A partner as large as what is not alone would be the best; a group may have only larger ones.
    rest = F.col("n") - F.col("alone")
    able = F.when(F.col("least") <= rest, 5 * rest >= 4 * F.col("n")).otherwise(5 * rest >= 4 * (F.col("least") + F.col("alone")))
    hopeful = stored(members.join(lone, "nid", "left").fillna(0, ["alone"]).where(able).drop("least"))
    reps = hopeful.groupBy("key").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("part"), "nid")).alias("rep"), F.count(F.lit(1)).alias("members")).where("members > 1")
    hopeful = stored(hopeful.join(reps.select("key", F.col("rep.nid").alias("rep")), "key"))
    star = stored(hopeful.where("nid <> rep").select(F.col("rep").alias("src"), F.col("nid").alias("dst")).distinct())
    judged = _judged(star, sets)
    links = stored(_links(judged, sizes))
    labels = _labels(links)

    state = hopeful.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    main = state.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    main = main.groupBy("key").agg(F.max(F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    left = state.where("nid <> rep").join(main.select("key", F.col("main.label").alias("main")), "key")
    left = stored(left.join(judged.select(F.col("src").alias("rep"), F.col("dst").alias("nid"), F.col("shared").alias("with_rep")), ["rep", "nid"]))
    left = stored(left.join(left.groupBy("nid").agg(F.collect_list("key").alias("keys")), "nid"))  # at most BANDS keys, and one for each fingerprint
    # One side outside the group's largest component: a large group of copies is not squared for a few others.
    a = left.where("label <> main").select("key", *[F.col(c).alias(f"a_{c}") for c in ("nid", "n", "alone", "label", "with_rep", "keys")])
    most = "least(n - alone, a_n - a_alone, least(with_rep, a_with_rep) + least(n - with_rep - alone, a_n - a_with_rep - a_alone))"
    first = "array_min(array_intersect(keys, a_keys)) = key"
    open_ = a.join(left, "key").where(f"a_label <> label AND (label = main OR a_nid < nid) AND {similar(most, 'n', 'a_n')} AND {first}")
    open_ = stored(open_.select(F.least("a_nid", "nid").alias("src"), F.greatest("a_nid", "nid").alias("dst")).distinct())
    more = _links(_judged(open_, sets), sizes)
    labels = labels if more.isEmpty() else _labels(links.unionByName(more))
    return nodes.select("nid", "node").join(labels, "nid", "left").select("node", F.coalesce("label", "nid").alias("label"))


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print, component, first): a row's id and the hash of its text, the smallest id reachable over
    pairs of similarity 0.8 or more, and the smallest text hash on that id in the component."""
    texts = text_frame(docs, id_col, text_col)
    sketches = stored(texts.withColumn("print", F.xxhash64("text")).mapInArrow(_sketches, "id long, print long, node binary, n long, bands array<long>, fp long"))
    prints = sketches.select("id", "print", "node").join(near_links(sketches, texts, stored(print_groups(sketches))), "node").select("id", "print", "label")
    roots = prints.groupBy("label").agg(F.min(F.struct("id", "print")).alias("root"))
    return prints.join(roots, "label").select("id", "print", F.col("root.id").alias("component"), F.col("root.print").alias("first"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, of the smallest id; rows are told apart by id and text, so an id that
    stands on different texts is judged text by text.
    A document without an id goes by a hash of its text, above any usual id."""
    key, mark = "key", "print"
    while key in docs.columns or mark in docs.columns:
        key, mark = f"_{key}", f"_{mark}"
    text = docs[text_col].cast("string")
    keyed = docs.withColumns({key: F.coalesce(docs[id_col].cast("long"), F.shiftrightunsigned(F.xxhash64(text), 1)), mark: F.xxhash64(text)})
    found = near_copy_components(keyed, key, text_col).where("id = component AND print = first")
    kept = stored(found.groupBy(F.col("id").alias("kept_id"), F.col("print").alias("kept_print")).agg(F.count(F.lit(1)).alias("rows")))
    # Only what several rows share needs the texts sorted; the others stream past a hash of narrow ids.
    once, shared = kept.where("rows = 1").hint("shuffle_hash"), kept.where("rows > 1")
    same = lambda x: (keyed[key] == x["kept_id"]) & (keyed[mark] == x["kept_print"])
    single = keyed.join(once, same(once), "left_semi")
    first = keyed.join(shared, same(shared), "left_semi").dropDuplicates([key, mark])
    return single.unionByName(first).select(*[F.col(f"`{c}`") for c in docs.columns])
