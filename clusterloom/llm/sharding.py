"""Sharding by size-tiered compaction over immutable Parquet shards and versioned manifests.

Every arrival is appended as small immutable files.  Files whose sizes lie within a factor of
``FANOUT`` form a tier; a tier with ``FANOUT`` runs or more is merged, packed into files of about
the target size, until no tier is that full.  A merge only ever adds files: what readers see changes
when a new manifest version appears, by a rename that fails if the version exists, so a lost
executor, a lost driver or a rival writer leave the old version whole.  Old files go when the
versions that name them are expired.

Merging moves no rows between tasks: each output file is one task that reads its inputs in turn.

Defined cases: rows are kept as they are (nulls, empty and long texts, repeated rows); an empty
arrival commits a version without new shards; all columns travel, and a partition column gets a
name that no input column has.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.sources.storage import shared_dir

TARGET = 128 << 20
FANOUT = 4
SMALLEST = 1 << 20  # files below this are one tier
MERGES = 64  # output files of one Spark job


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


def tier(size: int, fanout: int = FANOUT, smallest: int = SMALLEST) -> int:
    return 0 if size < smallest else 1 + int(math.log(size / smallest, fanout) + 1e-9)


def plan_merges(shards: list[Shard], target: int = TARGET, fanout: int = FANOUT, smallest: int = SMALLEST) -> list[list[Shard]]:
    """Groups of two or more shards of one tier, each at most about ``target`` together."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.size < 0.75 * target:
            tiers.setdefault(tier(s.size, fanout, smallest), []).append(s)
    groups = []
    for _, runs in sorted(tiers.items()):
        if len(runs) < fanout:
            continue
        group: list[Shard] = []
        for s in sorted(runs, key=lambda s: (s.size, s.path)):
            if group and sum(x.size for x in group) + s.size > 1.1 * target:
                groups.append(group)
                group = []
            group.append(s)
        groups.append(group)
    return [g for g in groups if len(g) > 1]


class ShardStore:
    """A folder of ``shards/`` and ``manifests/``, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(self.conf)
        self.jvm = jvm
        self.fs.mkdirs(self.path(f"{self.root}/manifests"))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(f"{self.root}/manifests"))]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self.path(self._name(version)))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:08d}.json"

    def commit(self, base: int, schema: T.StructType, shards: list[Shard]) -> int:
        """Publish version ``base + 1``; raises where another writer was first."""
        draft = self.path(f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": base + 1, "schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, self.path(self._name(base + 1)), options)
        except Exception:
            self.fs.delete(draft, False)
            raise
        return base + 1

    def _written(self, folder: str) -> list[Shard]:
        found, files = [], self.fs.listFiles(self.path(folder), True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                found.append(Shard(f.getPath().toString(), f.getLen()))
        return sorted(found, key=lambda s: s.path)

    def append(self, rows: DataFrame) -> int:
        """One arrival: new immutable shards and a version that adds them."""
        now = self.manifest()
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return self.commit(now["version"], rows.schema, [*(Shard(**s) for s in now["shards"]), *self._written(folder)])

    def append_arrivals(self, rows: DataFrame, arrival: Column) -> int:
        """Several arrivals written in one pass over ``rows``, committed one after another."""
        name = "arrival"
        while name in rows.columns:
            name = f"_{name}"
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        rows.withColumn(name, arrival).write.option("compression", "zstd").partitionBy(name).parquet(folder)
        arrived: dict[str, list[Shard]] = {}
        for s in self._written(folder):
            arrived.setdefault(s.path.rpartition("/")[0], []).append(s)
        now = self.manifest()
        version, shards = now["version"], [Shard(**s) for s in now["shards"]]
        for part in [arrived[k] for k in sorted(arrived)] or [[]]:
            shards = [*shards, *part]
            version = self.commit(version, rows.schema, shards)
        return version

    def _read(self, shards: list[Shard], schema: T.StructType) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards]).select(*[F.col(f"`{f.name}`") for f in schema])

    def compact(self, target: int = TARGET, fanout: int = FANOUT, smallest: int = SMALLEST) -> int:
        """Merge until no tier is full; one version for each round."""
        while True:
            now = self.manifest()
            shards = [Shard(**s) for s in now["shards"]]
            groups = plan_merges(shards, target, fanout, smallest)
            if not groups:
                return now["version"]
            schema = T.StructType.fromJson(now["schema"])
            made: list[Shard] = []
            batches = [groups[at : at + MERGES] for at in range(0, len(groups), MERGES)]
            # A job has a task for each of its files, so jobs run side by side until all cores have one.
            with self._apart(), ThreadPoolExecutor(1 + self.spark.sparkContext.defaultParallelism // MERGES) as pool:
                for shards_made in pool.map(lambda batch: self._write_apart([self._read(g, schema).coalesce(1) for g in batch]), batches):
                    made += shards_made
            gone = {s.path for g in groups for s in g}
            self.commit(now["version"], schema, [*(s for s in shards if s.path not in gone), *made])

    @contextmanager
    def _apart(self) -> Iterator[None]:
        """A union of single partitions keeps them; it is otherwise laid into one partition."""
        key = "spark.sql.unionOutputPartitioning"
        before = self.spark.conf.get(key, "true")
        self.spark.conf.set(key, "false")
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def _write_apart(self, parts: list[DataFrame]) -> list[Shard]:
        """One job that writes each of the single-partition ``parts`` to a file of its own."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        reduce(DataFrame.union, parts).write.option("compression", "zstd").parquet(folder)
        return self._written(folder)

    def expire(self, keep: int = 1) -> None:
        """Drop all versions but the last ``keep``, and the files that only they name."""
        last = self.version()
        kept = {s.path for v in range(max(1, last - keep + 1), last + 1) for s in self.shards(v)}
        for v in range(1, last - keep + 1):
            if self.fs.exists(self.path(self._name(v))):
                for s in self.shards(v):
                    if s.path not in kept and self.fs.exists(self.path(s.path)):
                        self.fs.delete(self.path(s.path), False)
                self.fs.delete(self.path(self._name(v)), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a committed version."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing was committed yet")
        return self._read([Shard(**s) for s in now["shards"]], T.StructType.fromJson(now["schema"]))


ARRIVALS = 8


def shard_documents(docs: DataFrame, root: str, id_col: str = "doc_id", target: int = TARGET) -> ShardStore:
    """``ARRIVALS`` appends of the documents, compacted to target-sized shards, old files expired."""
    store = ShardStore(docs.sparkSession, root)
    store.append_arrivals(docs, F.pmod(F.xxhash64(docs[id_col]), F.lit(ARRIVALS)))
    store.compact(target)
    store.expire()
    return store


def op3_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


OP3_SQL = "SELECT doc_id, lang, source, n_chars, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents"
