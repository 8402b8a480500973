"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source expects ``target / source_size`` copies.  Documents are laid out in a
fixed pseudo-random order inside size classes; the expected copies are prefix-summed along that
order, one offset per source is added, and a document is emitted once for every integer that its
step of the sum crosses.  Neighbouring size classes follow each other, so that the words taken of a
source stay near its target.

The prefix sum never gathers a source: buckets of (source, size class, first hash digits) are counted
first, their counts are summed, and a window numbers the
documents inside one bucket only.  Digits follow the number of rows, so that a bucket has about
``BUCKET`` rows at most; the order, and so the result, does not depend on them.

Defined cases: a null text has size 0; a null source is a source of its own, ranked last; a source
of size 0 has target 0 and takes nothing; equal rows are kept apart and each is numbered; rows that share an id
are ordered by size and text, rows without an id by their text, so reruns take the same texts; an empty
table gives an empty mix.  Input columns of any other name are carried, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WEIGHTS = 3  # weights 1, 2, 3, repeating over the ranked sources
CAP = 3  # a source is repeated at most three times
SEED = "mix-1"
BUCKET = 1 << 20  # rows


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of ``(k, s)`` rows, one for each source: shares by weight, capped at ``CAP * s``.

    Sources ordered by cap / weight are capped in turn while their cap is not above their share of
    what is left; that prefix is where the repeated resharing ends.
    """
    dec = "decimal(20,0)"
    t = sizes.withColumn("w", (F.row_number().over(Window.orderBy("k")) - 1) % WEIGHTS + 1)
    t = t.withColumn("cap", (F.col("s") * CAP).cast("long"))
    everything = Window.partitionBy()
    before = Window.orderBy((F.col("cap") * 6 / F.col("w")).cast("long"), "k").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("s").over(everything)).withColumn("weights", F.sum("w").over(everything))
    t = t.withColumn("left_w", (F.col("weights") - F.coalesce(F.sum("w").over(before), F.lit(0))).cast(dec))
    t = t.withColumn("left_t", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast(dec))
    t = t.withColumn("capped", F.col("cap").cast(dec) * F.col("left_w") <= F.col("w").cast(dec) * F.col("left_t"))
    free_w = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    share = (rest * F.col("w")).cast("double") / free_w
    return t.select("k", "s", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _plan(rows: DataFrame, seed: str) -> DataFrame:
    """``rows``: (id, k, size, t, ...); adds s, target and copies."""
    bits = F.length(F.bin("size"))
    digits, n = 2, rows.count()
    while n > BUCKET * 16**digits:
        digits += 1
    rows = rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.col("t"))).cast("binary")))
    rows = rows.withColumn("bits", bits).withColumn("c", F.expr("bits * 4 + shiftright(size * 4, bits - 1) - 4")).drop("bits")
    rows = rows.withColumn("b", F.substring("h", 1, digits))
    counts = rows.groupBy("k", "c", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    targets = source_targets(counts.groupBy("k").agg(F.sum("words").alias("s")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:offset:"), F.col("k")).cast("binary")), 1, 5), 16, 10).cast("double") / 2**20
    ahead = Window.partitionBy("k").orderBy("c", "b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    starts = starts.join(targets, "k").withColumn("offset", offset).drop("n", "words")
    place = Window.partitionBy("k", "c", "b").orderBy("h", "id", "size", "t")
    placed = rows.withColumn("at", F.row_number().over(place)).join(starts, ["k", "c", "b"])
    step = F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(F.lit(0.0))
    upto = lambda n: F.floor(n * step + F.col("offset"))
    n = F.col("ahead") + F.col("at")
    copies = F.least(upto(n) - upto(n - 1), F.lit(CAP)).cast("long")
    return placed.withColumn("copies", copies)


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    source = docs[source_col].cast("string")
    key = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("id"), key.alias("k"), word_count(text).alias("size"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("t"), *more)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """One row for every document: (id, size, source_size, target, copies, taken)."""
    placed = _plan(_rows(docs, id_col, text_col, source_col), seed)
    return placed.select("id", "size", F.col("s").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as the plan takes it, with all its columns."""
    carried = _rows(docs, id_col, text_col, source_col, F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"))
    placed = _plan(carried, seed).where("copies > 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return placed.select("row", times).select("row.*")


def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id AS id, coalesce('0' || source, '1') AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(text, '')) AS t, md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS h FROM documents),
r AS (SELECT *, length(bin(size)) * 4 + ((size * 4) >> (length(bin(size)) - 1)) - 4 AS c, h[1:2] AS b FROM d),
s AS (SELECT k, sum(size)::HUGEINT AS s, 3 * sum(size)::HUGEINT AS cap FROM r GROUP BY k),
w AS (SELECT *, ((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::HUGEINT AS w FROM s),
v AS (SELECT *, sum(s) OVER () AS total,
        sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap * 6 // w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w,
        sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY cap * 6 // w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_t FROM w),
q AS (SELECT *, cap * left_w <= w * left_t AS capped FROM v),
t AS (SELECT k, s, CASE WHEN capped THEN cap::DOUBLE ELSE
        ((total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * w)::DOUBLE
        / (sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target,
        ('0x' || md5('{SEED}:offset:' || k)[1:5])::BIGINT::DOUBLE / 1048576 AS u FROM q),
n AS (SELECT r.*, row_number() OVER (PARTITION BY k ORDER BY c, b, h, id, size, t) AS n FROM r)
SELECT n.id AS doc_id, n.size, t.s::BIGINT AS source_size, t.target,
       (n.size * CASE WHEN t.s > 0 THEN least(floor(n.n * (t.target / t.s::DOUBLE) + t.u) - floor((n.n - 1) * (t.target / t.s::DOUBLE) + t.u), 3) ELSE 0 END)::BIGINT AS taken
FROM n JOIN t USING (k)
"""
