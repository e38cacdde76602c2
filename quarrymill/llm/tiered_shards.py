"""Sharding by size-tiered compaction, with a versioned manifest.

A store is a folder: immutable Parquet shards and manifests. append() writes what arrives as small shards, one per
task or, in order, one per input file. compact() looks at the sizes in the manifest alone: shards fall into
tiers by size, and where a run of `fanout` or more shards of a tier lie next to each other, they are merged, tier
after tier, up to the target size; each merged file is then written once, from the arrivals it consists of, by
one task that reads them in order (no shuffle). A commit writes the next manifest under a temporary name and
renames it while holding an exclusively created lock file, so that readers see one version or the next, and two
writers can't both commit the same one. A writer that dies leaves its lock; after `lock_seconds` the next one removes it.
Readers of older versions keep working until vacuum(), which also deletes what failed attempts left.

Defined cases: an empty arrival adds no shard but a version; rows are kept as they are, whatever they hold; a lone
run smaller than fanout stays as it is until more arrives; a single arrival above the target is kept whole.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import publish
from .common import column, shared_dir

TAKEN = {"shard", "position", "_name"}


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def plan_merges(sizes: list[int], target: int, fanout: int, least: int = 1 << 20) -> list[list[int]]:
    """Groups of neighbouring shard numbers, in order: each group becomes one shard, groups of one stay."""

    def tier(n: int) -> int:
        t = 0
        while n >= least * fanout ** (t + 1):
            t += 1
        return t

    runs = [([i], n) for i, n in enumerate(sizes)]
    changed = True
    while changed:
        out, at = [], 0
        while at < len(runs):
            end = at
            while end < len(runs) and runs[end][1] < target and tier(runs[end][1]) == tier(runs[at][1]):
                end += 1
            if end - at >= fanout:
                group, total = [], 0
                for members, n in runs[at:end]:
                    if group and total + n > target:
                        out.append((group, total))
                        group, total = [], 0
                    group, total = group + members, total + n
                out.append((group, total))
                at = end
            else:
                out.append(runs[at])
                at += 1
        changed = len(out) < len(runs)
        runs = out
    return [members for members, _ in runs]


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None, lock_seconds: int = 900):
        self.spark, self.lock_seconds = spark, lock_seconds
        # a session of its own for copies, so that the user's settings stay: a union of single partitions must not become one
        self._copies = spark.newSession()
        self._copies.conf.set("spark.sql.unionOutputPartitioning", "false")
        self.root = (root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}").rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    # manifests

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "shards": [{"name", "bytes", "seq"}]}, in order; version 0 is the empty store."""
        known = self.versions()
        version = known[-1] if version is None and known else version or 0
        if version == 0:
            return {"version": 0, "shards": []}
        stream = self._fs.open(self._path(f"manifests/v{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, base: dict, shards: list[dict], schema: str | None) -> dict:
        new = {"version": base["version"] + 1, "schema": base.get("schema") or schema, "shards": shards}
        name = f"manifests/v{new['version']:010d}.json"
        lock = self._path(f"{name}.lock")
        if not self._lock(lock):
            raise Conflict(f"version {new['version']} is being written")
        try:  # the lock saves work; that one writer alone creates a version does not rest on it
            if not publish(self.spark, f"{self.root}/manifests", name.removeprefix("manifests/"), json.dumps(new)):
                raise Conflict(f"version {new['version']} is there")
        finally:
            self._fs.delete(lock, False)
        return new

    def _age(self, path) -> float:
        return time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000

    def _lock(self, lock) -> bool:
        """Creates the lock; one that is older than lock_seconds belongs to a writer that is gone."""
        for _ in range(2):
            try:
                self._fs.create(lock, False).close()
                return True
            except Exception:  # noqa: BLE001 - file systems have their own errors for a file that is there
                if not self._fs.exists(lock) or self._age(lock) < self.lock_seconds:
                    return False
                self._fs.delete(lock, False)
        return False

    # shards

    def _write(self, df: DataFrame) -> list[dict]:
        """Files of a folder of its own, by name; what a failed attempt leaves is in no manifest."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(folder))]
        return [{"name": f"{folder}/{n}", "bytes": size} for n, size in sorted(found) if n.endswith(".parquet")]

    def append(self, df: DataFrame, in_order: bool = False, at_once: int = 256) -> dict:
        """in_order: df reads files, and the order of their names and rows is kept: one shard per file.
        Columns named as those that read() adds are stored with _given behind their names. at_once: files that one
        job copies, which bounds its plan."""
        def named(x: DataFrame) -> DataFrame:
            return x.select(*[column(x, c).alias(f"{c}_given") if c.lower() in TAKEN else column(x, c) for c in x.columns])

        base = self.manifest()
        files = sorted(df.inputFiles()) if in_order else []
        if df.isEmpty():
            new = []
        elif files:
            lots = [files[a : a + at_once] for a in range(0, len(files), at_once)]
            new = [x for lot in lots for x in self._write(named(self._one_by_one([[f] for f in lot], df.schema)))]
        else:
            new = self._write(named(df))
        first = base["shards"][-1]["seq"] + 1 if base["shards"] else 0
        return self._commit(base, base["shards"] + [x | {"seq": first + i} for i, x in enumerate(new)], named(df).schema.json())

    def _one_by_one(self, groups: list[list[str]], schema) -> DataFrame:
        """A partition per group: its files' rows in order."""

        def one(files: list[str]) -> DataFrame:
            names = F.array(*[F.lit(f.rsplit("/", 1)[1]) for f in files])
            x = self._copies.read.schema(schema).parquet(*files)
            row = F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("_row")  # one column, so that no name in it can clash
            x = x.select(row, F.array_position(names, F.col("_metadata.file_name")).alias("_file_place"), F.col("_metadata.row_index").alias("_row_place"))
            x = x.coalesce(1).sortWithinPartitions("_file_place", "_row_place")
            return x.select(*[F.col("_row").getField(c).alias(c) for c in schema.names])

        return reduce(DataFrame.union, map(one, groups))

    def compact(self, target: int = 128 << 20, fanout: int = 4, at_once: int = 256) -> dict:
        """Merges runs of similar size; at_once: shards written by one job."""
        base = self.manifest()
        old = base["shards"]
        groups = plan_merges([s["bytes"] for s in old], target, fanout)
        merging = [g for g in groups if len(g) > 1]
        if not merging:
            return base
        schema = self.spark.createDataFrame([], _schema(base["schema"])).schema
        made: dict[int, dict] = {}
        for a in range(0, len(merging), at_once):
            some = merging[a : a + at_once]
            written = self._write(self._one_by_one([[f"{self.root}/{old[i]['name']}" for i in g] for g in some], schema))
            if len(written) != len(some):
                raise RuntimeError("a merged shard is missing")
            made |= {g[0]: x for g, x in zip(some, written)}
        shards = [made[g[0]] | {"seq": old[g[0]]["seq"]} if len(g) > 1 else old[g[0]] for g in groups]
        return self._commit(base, shards, None)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with their shard (its number in the manifest) and position in it."""
        m = self.manifest(version)
        if not m["shards"]:
            if not m.get("schema"):
                raise ValueError("nothing has arrived yet")
            empty = self.spark.createDataFrame([], _schema(m["schema"]))
            return empty.withColumn("shard", F.lit(0)).withColumn("position", F.lit(0).cast("long"))
        df = self.spark.read.schema(_schema(m["schema"])).parquet(*[f"{self.root}/{s['name']}" for s in m["shards"]])
        numbers = self.spark.createDataFrame([(s["name"].rsplit("/", 1)[1], i) for i, s in enumerate(m["shards"])], "_name string, shard int")
        df = df.select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("position"))
        if len(m["shards"]) <= 1_000_000:  # one row per shard
            numbers = F.broadcast(numbers)
        df = df.join(numbers, "_name")
        return df.select(*[column(df, c) for c in df.columns if c not in ("_name", "position", "shard")], "shard", "position")

    def vacuum(self, keep: int = 1, older_than: float = 86_400) -> int:
        """Deletes shards that the last `keep` versions don't name, and older manifests; also folders, locks and temporary
        manifests that no version names and that are older than `older_than` seconds: failed attempts left them. Returns how many shards went."""
        known = self.versions()
        stay = {s["name"] for v in known[-keep:] for s in self.manifest(v)["shards"]}
        named = {s["name"] for v in known for s in self.manifest(v)["shards"]}
        gone = named - stay
        for name in gone:
            self._fs.delete(self._path(name), False)
        for v in known[:-keep]:
            self._fs.delete(self._path(f"manifests/v{v:010d}.json"), False)
        folders = {n.rsplit("/", 1)[0] for n in stay}
        for parent, mine in (("data", lambda n: f"data/{n}" not in folders), ("manifests", lambda n: n.endswith((".tmp", ".lock")))):
            for s in self._fs.listStatus(self._path(parent)) if self._fs.exists(self._path(parent)) else []:
                name = s.getPath().getName()
                if mine(name) and (self._age(s.getPath()) > older_than or (parent == "data" and any(n.startswith(f"data/{name}/") for n in gone))):
                    self._fs.delete(s.getPath(), True)
        return len(gone)


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))


def shard(docs: DataFrame, root: str | None = None, target: int = 128 << 20, fanout: int = 4, in_order: bool = False) -> DataFrame:
    """Appends docs to a new store (or the one at root), compacts it, and reads it: docs' columns, shard, position. What compaction replaced is deleted
    in a new store, which nobody else reads yet; in one that is given, readers of older versions go on until vacuum() is called."""
    store = Store(docs.sparkSession, root)
    store.append(docs, in_order)
    store.compact(target, fanout)
    if root is None:
        store.vacuum()
    return store.read()
