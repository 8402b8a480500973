"""Runs of a configuration: clustering, refinements and evaluations as steps with a manifest each.

A step's folder holds its tables (CSV with header, written by Spark; names that end in ``.csv`` or ``.log`` are one file
each, put together from the sorted parts without one task holding them), texts such as ``entropy.txt``, ``run.log``, ``output.log`` and ``error.log`` (and ``cc.log``,
``wcc.log`` or ``cm.log`` of a refinement), ``done`` with SHA-256 and path of each single file, and ``done.json``: the parameters, the
content of the inputs and that of the tables, and the seconds of loading, running and saving.  A step whose manifest still holds is not run again.  The
manifest goes before a step begins and comes back by a rename after all tables are written, so a failed or
broken-off step is never taken for a finished one.  ``complete.log`` beside the outputs says what each run did, with the time.  ``alias.json`` in a folder names the folder whose tables
stand for it.  A failed refinement or evaluation is reported and the run goes on; a failed clustering raises.
"""

from __future__ import annotations

import json
import logging
import resource
import threading
import time
import traceback
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.functions import measures
from clusterloom.operators import blockmodel, graph, kcore, localmove, refine
from clusterloom.plans.config import Algorithm, Routes, allowed_refinements, parse_algorithm
from clusterloom.sources.edges import read_clustering, read_edges
from clusterloom.sources.storage import stored

log = logging.getLogger("clusterloom")
VERSION = 3  # of what the steps compute; a new one makes old manifests stale
BEST = {"sbm-flat-best": ("sbm-flat-dc", "sbm-flat-ndc", "sbm-flat-pp"), "sbm-nested-best": ("sbm-nested-dc", "sbm-nested-ndc")}
WEEK = 7 * 24 * 3600.0


@dataclass(frozen=True)
class Settings:
    """What a run does besides its algorithm; ``timeout`` in seconds holds for clustering and refinement steps."""

    stats: bool = False
    accuracy: bool = False
    refinements: tuple[str, ...] = ()
    criterion: str = ""
    seed: int = 1234
    timeout: float = WEEK
    weighted: bool = False
    iterations: int = 2


@dataclass
class Report:
    """Folders of the steps by name, with ``ran``, ``kept``, ``alias`` or ``failed: ...``."""

    steps: dict[str, str] = field(default_factory=dict)


class Files:
    """Small texts on any file system that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def sha256(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def joined(self, folder: str, path: str, header: str) -> None:
        """One file of a header and the part files of ``folder`` in order; the folder goes."""
        draft = f"{path}.{uuid.uuid4().hex}"
        fs, p = self._at(draft)
        parts = sorted(f.getPath().toString() for f in fs.listStatus(self._at(folder)[1]) if f.getPath().getName().startswith("part-"))
        out = fs.create(p, True)
        try:
            out.write(bytearray(header.encode()))
            for part in parts:
                stream = fs.open(self._at(part)[1])
                self.jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out)
                stream.close()
        finally:
            out.close()
        self.delete(path)
        fs.rename(p, self._at(path)[1])
        self.delete(folder)

    def append(self, path: str, text: str) -> None:
        """Add to a small text."""
        self.publish(path, (self.read(path) if self.exists(path) else "") + text)

    def publish(self, path: str, text: str) -> None:
        """Write under another name, then rename; what was there goes."""
        draft = f"{path}.{uuid.uuid4().hex}"
        fs, p = self._at(draft)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.delete(path)
        fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(path))


def content(spark: SparkSession, path: str) -> str:
    """Count and two sums of line hashes: the content of text files, whatever their parts and order."""
    lines = spark.read.text(path)
    h = F.xxhash64("value").cast("decimal(38,0)")
    g = F.xxhash64(F.lit("again"), F.col("value")).cast("decimal(38,0)")
    row = lines.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("h"), F.coalesce(F.sum(g), F.lit(0)).alias("g")).first()
    return f"{row['n']}:{row['h']}:{row['g']}"


def resolve(spark: SparkSession, folder: str) -> str:
    """The folder that holds the tables of ``folder``: itself, or what its alias names."""
    files = Files(spark)
    return json.loads(files.read(f"{folder}/alias.json"))["target"] if files.exists(f"{folder}/alias.json") else folder


def best_of(spark: SparkSession, folder: str) -> str | None:
    """The model that ``best_model.txt`` of a ``-best`` folder names, or None."""
    files = Files(spark)
    name = files.read(f"{folder}/best_model.txt").strip() if files.exists(f"{folder}/best_model.txt") else ""
    return name or None


def entropy_of(files: Files, path: str) -> float:
    """The one number of an ``entropy.txt``; raises if it holds anything else."""
    return float(files.read(path).strip())


def choose_best(spark: SparkSession, models: list[str], entropies: list[str], out: str) -> str:
    """Write ``models.txt`` and ``best_model.txt`` to ``out`` for models and their ``entropy.txt`` files, in this order."""
    if len(models) != len(entropies):
        raise ValueError(f"{len(models)} models, but {len(entropies)} entropy files")
    files = Files(spark)
    rows = [(i, name, entropy_of(files, path)) for i, (name, path) in enumerate(zip(models, entropies, strict=True))]
    best = measures.best_model(spark.createDataFrame(rows, "ord int, model string, entropy double")).first() if rows else None
    if best is None:
        raise ValueError("no model has an entropy")
    files.publish(f"{out}/models.txt", "".join(["model,entropy\n", *(f"{name},{value}\n" for _, name, value in rows)]))
    files.publish(f"{out}/best_model.txt", f"{best['model']}\n")
    return best["model"]


def cluster(edges: DataFrame, algorithm: Algorithm, seed: int = 1234, iterations: int = 2, rows: DataFrame | None = None) -> dict[str, DataFrame | str]:
    """Tables of a clustering step: ``com.csv``, and ``entropy.txt`` for block models.

    ``rows``: the edges with their place ``at``; IKC numbers clusters by the first appearance of their nodes in it."""
    if algorithm.family == "leiden":
        resolution = 1.0 if algorithm.resolution is None else algorithm.resolution
        return {"com.csv": localmove.local_move(edges, algorithm.model, resolution, seed, iterations)}
    if algorithm.family == "infomap":
        return {"com.csv": localmove.local_move(edges, "infomap", seed=seed)}
    if algorithm.family == "ikc":
        return {"com.csv": kcore.iterative_k_core(edges, algorithm.k, graph.node_index(rows, "at") if rows is not None else None).select("node_id", "cluster_id")}
    form, _, model = algorithm.model.partition("-")
    if form == "flat":
        blocks, length = blockmodel.fit_blocks(edges, model, seed)
    else:
        levels, length = blockmodel.nested_blocks(edges, model, seed)
        blocks = levels[0]
    return {"com.csv": graph.renumbered(graph.without_singletons(blocks)), "entropy.txt": f"{float(length)}\n"}


def history(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, nodes): what became of each cluster; ``after`` is null for nodes that are in none any more."""
    now = after.select("node_id", F.col("cluster_id").alias("after"))
    return before.select("node_id", F.col("cluster_id").alias("before")).join(now, "node_id", "left").groupBy("before", "after").agg(F.count(F.lit(1)).alias("nodes"))


def refined(edges: DataFrame, clustering: DataFrame, algorithm: Algorithm, kind: str, criterion: str, seed: int = 1234) -> DataFrame:
    """The base clustering after cc, wcc or cm."""
    wcc, cm = refine.criterion_text(criterion)
    if kind == "cc":
        return refine.connected_clusters(edges, clustering)
    if kind == "wcc":
        return refine.well_connected_clusters(edges, clustering, wcc)
    resolution = 1.0 if algorithm.resolution is None else algorithm.resolution
    return localmove.modified_clusters(edges, clustering, cm, algorithm.model, resolution, seed)


def evaluated(edges: DataFrame, clustering: DataFrame) -> dict[str, DataFrame]:
    return {
        "clusters": measures.cluster_stats(edges, clustering),
        "sizes": measures.size_distribution(clustering),
        "coverage": measures.coverage(edges, clustering),
        "cuts": refine.cluster_cuts(edges, clustering),
    }


class Runner:
    def __init__(self, spark: SparkSession, routes: Routes, settings: Settings):
        self.spark, self.routes, self.settings = spark, routes, settings
        self.files, self.report = Files(spark), Report()
        if not self.files.exists(routes.edges):
            raise FileNotFoundError(routes.edges)
        self.edges = read_edges(spark, routes.edges, settings.weighted)
        self.rows = read_edges(spark, routes.edges, ordered=True)

    def _holds(self, folder: str, key: dict) -> bool:
        if not self.files.exists(f"{folder}/done.json"):
            return False
        done = json.loads(self.files.read(f"{folder}/done.json"))
        if done["key"] != key:
            return False
        return all(self.files.exists(f"{folder}/{n}") and content(self.spark, f"{folder}/{n}") == c for n, c in done["tables"].items())

    def step(self, folder: str, params: dict, inputs: list[str], work: Callable[[], dict[str, DataFrame]], timeout: float | None = None) -> str:
        """Run ``work`` and write its tables, unless the manifest of ``folder`` says that they stand.

        ``run.log`` and ``output.log`` hold the phases; ``error.log`` the error if there is one, the time and the driver's peak memory."""
        lines, errors, load = [], [], time.perf_counter()
        tell = lambda text: lines.append(f"{time.strftime('%Y-%m-%d %H:%M:%S')} {text}\n")
        tell(f"begin {folder} {json.dumps(params)}")
        key = {"version": VERSION, "params": params, "inputs": {p: content(self.spark, p) for p in inputs}}
        if self._holds(folder, key):
            self.report.steps[folder] = "kept"
            return folder
        self.files.delete(f"{folder}/done.json")
        self.files.delete(f"{folder}/alias.json")
        sc, group, began = self.spark.sparkContext, uuid.uuid4().hex, time.perf_counter()
        timer = None
        if timeout:
            sc.setJobGroup(group, folder, interruptOnCancel=True)
            timer = threading.Timer(timeout, sc._jsc.sc().cancelJobGroupAndFutureJobs, [group])
            timer.daemon = True
            timer.start()
        try:
            tell(f"loaded in {began - load:.3f} s")
            tables = work()
            ran = time.perf_counter()
            tell(f"ran in {ran - began:.3f} s")
            for name, table in tables.items():
                self._save(folder, name, table)
            saved = time.perf_counter()
            tell(f"saved in {saved - ran:.3f} s")
        except Exception as e:
            self.report.steps[folder] = f"failed: {str(e)[:200]}"
            tell(self.report.steps[folder])
            errors.append(traceback.format_exc())
            raise
        finally:
            if timer:
                timer.cancel()
                sc.setLocalProperty("spark.jobGroup.id", None)
            errors.append(f"elapsed seconds: {time.perf_counter() - load:.3f}\nmaximum resident set of the driver's Python: {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss} KB\n")
            self.files.publish(f"{folder}/error.log", "".join(errors))
            for name in ("run.log", "output.log", *([f"{params['refinement']}.log"] if "refinement" in params else [])):
                self.files.publish(f"{folder}/{name}", "".join(lines))
        held = {n: content(self.spark, f"{folder}/{n}") for n in tables}
        single = [f"{folder}/{n}" for n, t in tables.items() if isinstance(t, str) or n.endswith((".csv", ".log"))]
        self.files.publish(f"{folder}/done", "".join(f"{self.files.sha256(p)}  {p}\n" for p in single))
        self.files.publish(f"{folder}/done.json", json.dumps({"key": key, "tables": held, "seconds": {"load": round(began - load, 3), "run": round(ran - began, 3), "save": round(saved - ran, 3)}}))
        self.report.steps[folder] = "ran"
        return folder

    def _save(self, folder: str, name: str, table: DataFrame | str) -> None:
        path = f"{folder}/{name}"
        if isinstance(table, str):
            self.files.publish(path, table)
        elif name.endswith((".csv", ".log")):
            order = [c for c in ("cluster_id", "before") if c in table.columns] + table.columns
            table.orderBy(*dict.fromkeys(order)).write.mode("overwrite").csv(f"{path}.parts")
            self.files.joined(f"{path}.parts", path, ",".join(table.columns) + "\n")
        else:
            table.write.mode("overwrite").option("header", True).csv(path)

    def _optional(self, *args, **more) -> str | None:
        try:
            return self.step(*args, **more)
        except Exception as e:  # reported; the base clustering stands
            log.warning("%s failed: %s", args[0], str(e)[:200])
            return None

    def _evaluate(self, com: str, tag: tuple[str, ...]) -> None:
        found = lambda: read_clustering(self.spark, com)
        if self.settings.stats:
            self._optional(self.routes.output("stats", *tag), {}, [self.routes.edges, com], lambda: evaluated(self.edges, found()))
        if self.settings.accuracy and not self.routes.truth:
            log.warning("no ground truth: accuracy is left out")
        elif self.settings.accuracy:
            truth = lambda: read_clustering(self.spark, self.routes.truth)
            self._optional(
                self.routes.output("acc", *tag), {}, [self.routes.edges, com, self.routes.truth],
                lambda: {"result": measures.accuracy(graph.nodes(self.edges), truth(), found()), "ami": measures.adjusted_information(truth(), found())},
            )

    def _refined(self, com: str, algorithm: Algorithm, kind: str) -> dict[str, DataFrame]:
        before = read_clustering(self.spark, com)
        after = refined(self.edges, before, algorithm, kind, self.settings.criterion, self.settings.seed)
        if kind != "cm":
            return {"com.csv": after}
        after = stored(after)
        return {"com.csv": after, "history.log": history(before, after)}

    def run(self, name: str) -> Report:
        """``steps_of`` a name, with an entry in ``complete.log``."""
        try:
            return self.steps_of(name)
        finally:
            now = time.strftime("%Y-%m-%d %H:%M:%S")
            self.files.append(f"{self.routes.root}/complete.log", "".join(f"{now} {name} {state} {folder}\n" for folder, state in self.report.steps.items()))

    def steps_of(self, name: str) -> Report:
        """All steps of an algorithm; a ``-best`` name runs its models and aliases the winner's folders."""
        algorithm, s = parse_algorithm(name), self.settings
        wanted = allowed_refinements(algorithm, s.refinements)
        for r in set(s.refinements) - set(wanted):
            log.warning("%s does not take %s: left out", name, r)
        if name in BEST:
            return self._best(name, wanted)
        base = self.step(self.routes.output("clusterings", name), {"algorithm": name, "seed": s.seed, "weighted": s.weighted, "iterations": s.iterations}, [self.routes.edges], lambda: cluster(self.edges, algorithm, s.seed, s.iterations, self.rows), s.timeout)
        com = f"{base}/com.csv"
        self._evaluate(com, (name,))
        for kind in wanted:
            tag = (name, kind, s.criterion)
            out = self._optional(
                self.routes.output("clusterings", *tag), {"algorithm": name, "refinement": kind, "criterion": s.criterion, "seed": s.seed}, [self.routes.edges, com],
                lambda kind=kind: self._refined(com, algorithm, kind), timeout=s.timeout,
            )
            if out:
                self._evaluate(f"{out}/com.csv", tag)
        return self.report

    def _best(self, name: str, wanted: tuple[str, ...]) -> Report:
        for child in BEST[name]:
            self.steps_of(child)
        own = self.routes.output("clusterings", name)
        best = choose_best(self.spark, list(BEST[name]), [f"{self.routes.output('clusterings', child)}/entropy.txt" for child in BEST[name]], own)
        for kind in ("clusterings", "stats", "acc"):
            for tag in ((), *((r, self.settings.criterion) for r in wanted)):
                target, alias = self.routes.output(kind, best, *tag), self.routes.output(kind, name, *tag)
                if self.files.exists(f"{target}/done.json"):
                    self.files.publish(f"{alias}/alias.json", json.dumps({"target": target}))
                    self.report.steps[alias] = "alias"
                else:  # an older run's winner must not stand for this one
                    self.files.delete(f"{alias}/alias.json")
        return self.report
