"""Streams: vendors deduplicated as they come, batches enriched and scored, feeds ingested exactly once.

Back-pressure is the source's maxFilesPerTrigger; a batch that fails is run again from the checkpoint, not lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import ingest
from ..session import checkpointed
from ..sources.store import Change, Store, append_new


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unique_stream(stream: DataFrame, key: Column) -> DataFrame:
    """The first row of every key; keys are state that grows with their number."""
    return stream.withColumn("vendor_key", key).dropDuplicates(["vendor_key"])


def unique_within(stream: DataFrame, key: Column, time: str, delay: str) -> DataFrame:
    """The first row of every key within the watermark: bounded state for streams without end."""
    return stream.withColumn("vendor_key", key).withWatermark(time, delay).dropDuplicatesWithinWatermark(["vendor_key"])


def enrich_stream(stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch is enriched; rows with content are scored and written to a folder named after the batch, which is
    overwritten if the batch is run again."""

    def run(batch: DataFrame, number: int) -> None:
        rows = enrich(batch)
        ready = rows.where(F.coalesce("website_content", F.lit("")) != "")
        score(ready).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_stream(stream: DataFrame, source: str, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Contract rows of a stream rolled up into the tables vendors and ledger of the store at root. Chunks the ledger knows are left out, so a
    batch or a file that comes again changes nothing. A batch reads and writes the buckets of the vendors that it brings, and its vendors and
    digests are committed at once."""
    store = Store(stream.sparkSession, root)

    def run(batch: DataFrame, number: int) -> None:
        rows = checkpointed(ingest.chunks(batch))
        empty = batch.sparkSession.createDataFrame([], "source string, digest string")

        def merge(change: Change) -> None:
            new, digests = ingest.unseen(rows, change.read("ledger", empty), source)
            digests = checkpointed(digests)
            if not digests.isEmpty():
                delta = ingest.contract_rollup(ingest.contract_rows(new.drop("chunk")), source)
                change.upsert("vendors", delta, ["source", "external_id"], ingest.upsert_vendors, buckets)
                change.upsert("ledger", digests, ["source", "digest"], append_new(["source", "digest"]), buckets)

        store.transact(merge)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary(query: StreamingQuery) -> dict:
    """Batches, rows and seconds of a query."""
    progress = query.recentProgress
    seconds = [p["durationMs"].get("triggerExecution", 0) / 1000 for p in progress]
    return {"batches": len(progress), "rows": sum(p["numInputRows"] for p in progress), "seconds": sum(seconds), "longest": max(seconds, default=0.0)}


def streams(scorer_is_async: bool, batch_size: int, least: int = 50) -> bool:
    """Whether a run is worth streaming."""
    return scorer_is_async and batch_size >= least


# Extension beyond the reference: windows by event time


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows per key and window of event time; rows later than the delay are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
