"""Mixing sources to target weights by proportionate-fair scheduling.

The rows of a source are cut into blocks, and weights are integers a of total D. In the fluid schedule every source that
has blocks left is served in proportion to its weight; when one runs out, the others share its part. A block is
released in the slot in which the fluid schedule begins it and due at the end of the slot in which it is done; earliest deadline first
fills one slot after the other, so at every slot each source is less than one block from the fluid schedule.

While the fluid schedule serves D blocks of all, every source gets exactly a of its blocks, however long the others last. So the
schedule falls into periods that don't depend on one another: period k takes the blocks ka .. ka + a - 1 of each source. Periods are
worked out in parallel on executors; the driver holds one row per source and no schedule. A period has
at most D blocks, and D is at most `most` plus the number of sources (larger weights are divided by their greatest common divisor, then scaled).

Numbering the rows of a source needs no task that holds the source: rows fall into ranges of a hash of id and content, ranges
are counted, and numbers are offsets plus places inside a range.

Defined cases: a null source counts as ''. Sources without a weight get weight 1; weights below 1 are an error. Null
ids and repeated rows are rows like others; rows equal in every column may change places. An empty table gives an empty result.
Columns named as those that are added (in any case) are kept with _given behind their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import column, materialize, require

ADDED = ("mix_source", "mix_period", "mix_block", "mix_slot", "mix_order")


def fluid(weights: np.ndarray, blocks: np.ndarray):
    """The fluid schedule of a period as a function: from (j, a) to the slots, rounded down and up, after which every source has been served
    j / a of its weight, or all it has. Integer arithmetic; weights and blocks are those of the sources with blocks left."""
    ends = np.sort(blocks / weights)
    order = np.argsort(blocks / weights, kind="stable")
    running = int(weights.sum()) - np.concatenate([[0], np.cumsum(weights[order])])
    done = np.concatenate([[0], np.cumsum(blocks[order])])

    def at(j: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(ends, j / a, side="right")
        served = j * running[k]
        return done[k] + served // a, done[k] - (-served // a)

    return at


def period(weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """(source, block) by slot: sources are numbers of these lists, and blocks[i] <= weights[i] of source i are placed."""
    weights, blocks = np.asarray(weights, np.int64), np.asarray(blocks, np.int64)
    source = np.repeat(np.arange(len(weights)), blocks)
    j = np.arange(len(source)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = fluid(weights, blocks)
    release, due = at(j, weights[source])[0], at(j + 1, weights[source])[1]
    by_release = np.argsort(release, kind="stable")
    out, ready, n = np.empty((len(source), 2), np.int64), [], 0
    for t in range(len(source)):
        while n < len(source) and release[by_release[n]] <= t:
            i = int(by_release[n])
            heapq.heappush(ready, (int(due[i]), int(source[i]), int(j[i])))
            n += 1
        _, out[t, 0], out[t, 1] = heapq.heappop(ready)
    return out


def tempered(rows: dict[str, int], power: float = 0.5, grid: int = 1024) -> dict[str, int]:
    """Weights by a power of the sources' sizes: small sources weigh more than their share of rows."""
    total = sum(n**power for n in rows.values()) or 1
    return {s: max(1, round(grid * n**power / total)) for s, n in rows.items()}


def reduced(weights: dict[str, int], most: int) -> dict[str, int]:
    """The same proportions in smaller integers; exact unless their sum still exceeds `most`."""
    if min(weights.values(), default=1) < 1:
        raise ValueError("weights are integers from 1 up")
    by = math.gcd(*weights.values()) if weights else 1
    total = sum(weights.values()) // by
    return {s: w // by if total <= most else max(1, round(w // by * most / total)) for s, w in weights.items()}


def _source(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def _blocks(spark, blocks: dict[str, int], weights: dict[str, int], periods_per_task: int = 256) -> DataFrame:
    """(bs, bb, mix_period, mix_slot) for every block bb of every source bs."""
    names = sorted(blocks, key=lambda s: (-(-blocks[s] // weights[s]), s))
    n, a = np.array([blocks[s] for s in names], np.int64), np.array([weights[s] for s in names], np.int64)
    last = -(-n // a)  # periods that a source takes part in; sources are sorted by them
    count = int(last.max(initial=0))
    running = int(a.sum()) - np.concatenate([[0], np.cumsum(a)])
    finished = np.concatenate([[0], np.cumsum(n)])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple | None = None
        for b in batches:
            for k in b["id"].tolist():
                first = int(np.searchsorted(last, k, side="right"))  # sources before it have run out
                left = np.minimum(a[first:], n[first:] - k * a[first:])
                if known is None or known[0] != first or (left < a[first:]).any() or not known[1]:
                    known = (first, bool((left == a[first:]).all()), period(a[first:], left))
                order = known[2]
                who = order[:, 0] + first
                gone = int(np.searchsorted(last, k, side="right"))
                base = int(finished[gone]) + k * int(running[gone])
                yield pd.DataFrame({"bs": [names[i] for i in who.tolist()], "bb": order[:, 1] + k * a[who], "mix_period": k, "mix_slot": base + np.arange(len(order))})

    tasks = max(1, -(-count // periods_per_task))
    return spark.range(0, count, 1, tasks).mapInPandas(work, "bs string, bb long, mix_period long, mix_slot long")


def mix(
    docs: DataFrame, weights: dict[str, int] | None = None, id_col: str = "doc_id", source_col: str = "source",
    block_rows: int = 16, range_rows: int = 1024, most: int = 1 << 16, broadcast_blocks: int = 1_000_000,
) -> DataFrame:
    """docs with mix_source, mix_period, mix_block (of its source), mix_slot and mix_order (unique, from 0, with gaps
    where the last block of a source is short). Default weights: tempered() of the sources' rows. Up to broadcast_blocks blocks are
    broadcast to the rows; more are joined by a shuffle."""
    require(docs, id_col, source_col)
    spark = docs.sparkSession
    # one row per source: as many as a period has to hold in one task anyway
    rows = {r[0]: r[1] for r in docs.groupBy(_source(column(docs, source_col))).count().collect()}
    total = sum(rows.values())
    own = reduced({s: (weights or {}).get(s, 1) for s in rows} if weights else tempered(rows), most + len(rows))
    blocks = materialize(_blocks(spark, {s: -(-n // block_rows) for s, n in rows.items()}, own), "mix-blocks")
    if sum(-(-n // block_rows) for n in rows.values()) <= broadcast_blocks:
        blocks = F.broadcast(blocks)

    ranges = max(1, min(1 << 31, -(-total // range_rows)))
    # the row goes along as one column, so that no name in it can clash
    row = F.struct(*[column(docs, c).alias(c) for c in docs.columns]).alias("_doc")
    content = [column(docs, f.name) for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    x = docs.select(row, _source(column(docs, source_col)).alias("mix_source"), column(docs, id_col).cast("string").alias("_id"), F.xxhash64(F.lit(31), *content).alias("_h"))
    x = x.withColumn("_range", F.floor(F.shiftrightunsigned("_h", 32) * F.lit(ranges) / F.lit(float(1 << 32))))
    # one row per source and range, counted in two steps, so that no task adds up all ranges of a source
    sizes = x.groupBy("mix_source", "_range").agg(F.count("*").alias("_n")).withColumn("_lot", F.floor(F.col("_range") / 4096))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    lots = sizes.groupBy("mix_source", "_lot").agg(F.sum("_n").alias("_of_lot"))
    lots = lots.select("mix_source", "_lot", F.coalesce(F.sum("_of_lot").over(before("mix_source", "_lot")), F.lit(0)).alias("_lots_before"))
    sizes = sizes.withColumn("_in_lot", F.coalesce(F.sum("_n").over(before("mix_source", "_lot", "_range")), F.lit(0))).join(lots, ["mix_source", "_lot"])
    sizes = sizes.select("mix_source", "_range", (F.col("_lots_before") + F.col("_in_lot")).alias("_before"))
    inside = Window.partitionBy("mix_source", "_range").orderBy("_h", F.col("_id").asc_nulls_last())
    x = x.withColumn("_place", F.row_number().over(inside) - 1).join(sizes, ["mix_source", "_range"])
    x = x.withColumn("_at", F.col("_before") + F.col("_place")).withColumn("mix_block", F.floor(F.col("_at") / block_rows))
    x = x.join(blocks, (F.col("mix_source") == F.col("bs")) & (F.col("mix_block") == F.col("bb")))
    x = x.withColumn("mix_order", F.col("mix_slot") * block_rows + F.col("_at") % block_rows)
    given = [F.col("_doc").getField(c).alias(f"{c}_given" if c.lower() in ADDED else c) for c in docs.columns]
    return x.select(*given, *ADDED)


def in_order(docs: DataFrame, chunk_rows: int = 4096, **options) -> DataFrame:
    """All rows of docs, columns as they were, dealt to partitions of about chunk_rows rows in mixing order: the
    files written from it, by name, and their rows are the mixed sequence."""
    mixed = mix(docs, **options)
    parts = max(1, -(-docs.count() // chunk_rows))
    chunk = F.least(F.floor(F.col("mix_order") / chunk_rows), F.lit(parts - 1)).cast("int")
    out = mixed.repartitionById(parts, chunk).sortWithinPartitions("mix_order")
    return out.select(*[column(out, f"{c}_given").alias(c) if c.lower() in ADDED else column(out, c) for c in docs.columns])
