"""Tables in buckets behind one version, which is put in place atomically.

A store is a folder: `data/<id>/_bucket=<n>` holds files that never change, `versions/<n>.json` says which of them make up each table at
version n, and the highest number is the current version. A change reads one version, writes new folders for the buckets it touches and
commits all its tables at once by creating the next number, which only one writer can: on other file systems by a rename that does not
replace, on a local disk by a hard link. So readers see a version whole or not at all, whatever is written beside them; a writer that dies leaves
folders that no version names; and a writer that comes second works its change out again on the new version.

Rows lie in the bucket of their key's hash. An upsert reads and writes the buckets of the keys that it brings, not the table; rows known to be new are
added in further folders of their buckets. Old versions and folders
without a version are deleted by vacuum(), by age alone; the age has to exceed the longest read and the longest change.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpointed

T = TypeVar("T")
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another change was committed first."""


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _folders(files: dict[str, str | list[str]]) -> list[str]:
    """The folders of buckets; one that was extended has several."""
    return [f for own in files.values() for f in ([own] if isinstance(own, str) else own)]


def publish(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Creates a file with this text, whole or not at all; False if one of that name is there. Of several writers one succeeds: the rename does not replace,
    and a local disk, where it would, has hard links."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    own, target = path(f"{folder}/.{uuid.uuid4().hex}.tmp"), path(f"{folder}/{name}")
    fs = target.getFileSystem(conf)
    fs.mkdirs(path(folder))
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(own.toUri().getPath(), target.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(own, target, none)
        return True
    except Exception as e:
        if isinstance(e, FileExistsError) or "FileAlreadyExists" in str(e) or fs.exists(target):
            return False
        raise
    finally:
        if fs.exists(own):
            fs.delete(own, False)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> dict[str, float]:
        """Names in a folder with the seconds at which they were last changed."""
        at = self._path(f"{self.root}/{folder}")
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._fs.listStatus(at)} if self._fs.exists(at) else {}

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._list("versions") if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The current version, -1 before the first change."""
        return max(self.versions(), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            return {"version": -1, "tables": {}, "meta": {}}
        stream = self._fs.open(self._path(f"{self.root}/versions/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is at a version; of the current one by default."""
        return self._table(self.manifest(version)["tables"][name])

    def _table(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        wanted = _folders({b: f for b, f in table["files"].items() if buckets is None or int(b) in set(buckets)})
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in wanted]) if wanted else self.spark.createDataFrame([], schema)

    def begin(self) -> Change:
        return Change(self, self.manifest())

    def transact(self, work: Callable[[Change], T], attempts: int = 10) -> T:
        """Commits what work does to a change; from the start again where another writer came first."""
        for n in range(attempts):
            change = self.begin()
            try:
                out = work(change)
                change.commit()
                return out
            except Conflict:
                if n + 1 == attempts:
                    raise
            except BaseException:
                change.abandon()
                raise
        raise ValueError("attempts must be at least 1")

    def _publish(self, version: int, manifest: dict) -> None:
        """Creates a version that is not there yet, whole or not at all."""
        if not publish(self.spark, f"{self.root}/versions", f"{version:012d}.json", json.dumps(manifest)):
            raise Conflict(f"version {version} is there already")

    def vacuum(self, seconds: float) -> int:
        """Deletes versions that were replaced longer ago than this, and folders of that age which no version left names. How many folders went."""
        limit, written = time.time() - seconds, self._list("versions")
        numbers = self.versions()
        stay = [v for v, following in zip(numbers, [*numbers[1:], None]) if following is None or written[f"{following:012d}.json"] > limit]
        for v in set(numbers) - set(stay):
            self._delete(f"versions/{v:012d}.json")
        for name in [n for n, at in written.items() if n.endswith(".tmp") and at <= limit]:
            self._delete(f"versions/{name}")
        named = {f for v in stay for t in self.manifest(v)["tables"].values() for f in _folders(t["files"])}
        gone = 0
        for folder, at in self._list("data").items():
            if at > limit:
                continue
            parts = [f"data/{folder}/{p}" for p in self._list(f"data/{folder}") if p.startswith(BUCKET)]
            loose = [p for p in parts if p not in named]
            gone += len(loose)
            for p in [f"data/{folder}"] if len(loose) == len(parts) else loose:
                self._delete(p)
        return gone


class Change:
    """What one writer is about to commit on top of a version."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.base = store, manifest["version"]
        self.tables, self.meta = dict(manifest["tables"]), dict(manifest["meta"])
        self._before = json.dumps([manifest["tables"], manifest["meta"]], sort_keys=True)
        self._written: list[str] = []

    def read(self, name: str, like: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as this change sees it; an empty one like `like` before it is there."""
        if name not in self.tables and like is not None:
            return like.limit(0)
        return self.store._table(self.tables[name], buckets)

    def _write(self, df: DataFrame, keys: list[str], buckets: int, touched: int) -> dict[str, str]:
        folder = f"data/{uuid.uuid4().hex}"
        self._written.append(folder)
        spread = max(1, int(self.store.spark.conf.get("spark.sql.shuffle.partitions")) // max(touched, 1))
        rows = df.withColumn(BUCKET, bucket_of(keys, buckets)).withColumn("_part", F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(spread)))
        rows.repartition(max(touched, 1) * spread, BUCKET, "_part").drop("_part").write.partitionBy(BUCKET).parquet(f"{self.store.root}/{folder}")
        found = [n for n in self.store._list(folder) if n.startswith(BUCKET + "=")]
        return {n.split("=")[1]: f"{folder}/{n}" for n in found}

    def extend(self, name: str, rows: DataFrame) -> None:
        """Adds rows, which the caller knows to be new, in folders of their own beside those of their buckets. Each task writes what it has: rows that are many
        times what they were made of are neither shuffled nor sorted."""
        table, conf = self.tables[name], self.store.spark.conf
        folder, writers = f"data/{uuid.uuid4().hex}", "spark.sql.maxConcurrentOutputFileWriters"
        self._written.append(folder)
        known = conf.get(writers)
        conf.set(writers, str(table["buckets"]))  # else a sort by bucket comes first
        try:
            own = rows.select(*[f["name"] for f in table["schema"]["fields"]]).withColumn(BUCKET, bucket_of(table["keys"], table["buckets"]))
            own.write.partitionBy(BUCKET).parquet(f"{self.store.root}/{folder}")
        finally:
            conf.set(writers, known)
        files = dict(table["files"])
        for n in self.store._list(folder):
            if n.startswith(BUCKET + "="):
                b = n.split("=")[1]
                files[b] = [*_folders({b: files[b]} if b in files else {}), f"{folder}/{n}"]
        self.tables[name] = {**table, "files": files}

    def put(self, name: str, df: DataFrame, keys: list[str], buckets: int = 16) -> None:
        """The whole table anew."""
        self.tables[name] = {"schema": json.loads(df.schema.json()), "keys": keys, "buckets": buckets, "files": self._write(df, keys, buckets, buckets)}

    def upsert(self, name: str, delta: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 16) -> None:
        """merge(stored rows, delta) takes the place of the buckets that delta's keys lie in. merge has to return rows of these buckets only, and all of
        them; `buckets` counts where the table is new."""
        table = self.tables.get(name)
        if table and table["keys"] != keys:
            raise ValueError(f"{name} is kept by {table['keys']}")
        buckets = table["buckets"] if table else buckets
        rows = checkpointed(delta.withColumn(BUCKET, bucket_of(keys, buckets)))
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # as many as there are buckets
        if not touched:
            if not table:
                self.put(name, delta.limit(0), keys, buckets)
            return
        delta = rows.drop(BUCKET)
        merged = merge(self.read(name, delta, touched), delta)
        if table and [f.name for f in merged.schema] != [f["name"] for f in table["schema"]["fields"]]:
            raise ValueError(f"{name} has other columns: {merged.columns}")
        files = self._write(merged, keys, buckets, len(touched))
        if not {int(b) for b in files} <= set(touched):
            raise ValueError("merge has returned rows of other buckets")
        left = {b: f for b, f in table["files"].items() if int(b) not in set(touched)} if table else {}
        self.tables[name] = {"schema": table["schema"] if table else json.loads(merged.schema.json()), "keys": keys, "buckets": buckets, "files": left | files}

    def update(self, name: str, delta: DataFrame, keys: list[str]) -> None:
        """Sets the other columns of delta in the rows with its keys; keys that the table does not hold change nothing."""

        def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
            own = new.select(*keys, F.struct(*[F.col(c) for c in new.columns if c not in keys]).alias("_new"), F.lit(True).alias("_hit"))
            both = stored.join(own, keys, "left")
            return both.select(*[F.when(F.col("_hit"), F.col(f"_new.{c}").cast(stored.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new.columns and c not in keys else F.col(c) for c in stored.columns])

        self.upsert(name, delta, keys, merge)

    def commit(self) -> int:
        """The new version; the old one if nothing changed."""
        if json.dumps([self.tables, self.meta], sort_keys=True) == self._before:
            return self.base
        try:
            self.store._publish(self.base + 1, {"version": self.base + 1, "tables": self.tables, "meta": self.meta})
        except BaseException:
            self.abandon()
            raise
        return self.base + 1

    def abandon(self) -> None:
        for folder in self._written:
            self.store._delete(folder)


def append_new(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that adds the rows whose keys are not stored; of several with one key, any."""
    return lambda stored, delta: stored.unionByName(delta.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def replace_rows(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge in which rows of delta take the place of those with their keys."""
    return lambda stored, delta: stored.join(delta.select(*keys).distinct(), keys, "left_anti").select(*stored.columns).unionByName(delta.select(*stored.columns))
