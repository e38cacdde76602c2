"""Helpers shared by the training-data operators: tables, the shared folder, materialised steps."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: Strings standing for "the largest id": rows without an id sort after every other row.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's steps, within the one that driver and executors share; checkpoints go to the latter."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(session.shared_dir(spark))
    return session.step_dir(spark)


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Writes a step to the shared folder as Parquet and reads it back, which cuts the lineage. A lost
    executor loses nothing of it: the files are where every other executor reads them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarrymill_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a step that nothing reads any more."""
    path = getattr(df, "_quarrymill_path", None)
    if path:
        hadoop_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
        fs.delete(hadoop_path, True)


def column(df: DataFrame, name: str) -> Column:
    """The column of that name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are needed; the table has {df.columns}")


def remainder_of_id(col: Column, mod: int) -> Column:
    """crc32(id as text) mod `mod`; a null id counts as the text ''."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound (memory stays bounded on any input)."""

    def __init__(self, seed: int = 0, bound: int = 100_000):
        super().__init__()
        self.seed, self.bound = seed, bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def public_tokenizer(name: str) -> str:
    """The path of a vocabulary file of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
