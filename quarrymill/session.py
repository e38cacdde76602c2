"""Sessions and steps that cut the lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset and all run on this
    machine, as in tests. On a cluster it has to be set."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarrymill.shared.dir", None)
    if not known and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        spark.conf.set("quarrymill.shared.dir", known)
    return known.rstrip("/")


def step_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark)}/quarrymill-{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{step_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Deletes the steps of this application. To be called when no result of its queries is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(step_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def share_code(spark: SparkSession) -> None:
    """Lets Python workers of this machine import the package from where it lies, whatever folder the driver was
    started in. On a cluster it is installed or sent with --py-files; the path does no harm there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def local_session(cores: str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    share_code(spark)
    return spark
