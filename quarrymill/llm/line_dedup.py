"""Line deduplication: range-partitioned line hashes in, keep bitmaps per document out.

Lines are hashed to 128 bits in the JVM; only (hash, document, position) is moved, never text. Rows are
range-partitioned and sorted by (hash, document, position), so that a very frequent line spreads over
as many partitions as its rows need. One streaming pass writes down where each partition begins and ends
(a few numbers per partition); with these, a second pass streams every partition and knows the first
document of a line even if that document lies in an earlier partition. Positions that go are packed into
a zlib-compressed bitmap per document.

Defined cases: null or empty text is one empty line. A null id counts as one document after all others.
Rows that repeat an id are one document, and each row gets its own bitmap (rows equal in id and text share one).
Lines whose key is shorter than min_chars are never dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, materialize, release, require

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    require(docs, id_col, text_col)
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)).alias("d"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    ).withColumn("r", F.xxhash64("text"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(d, r, n_lines, n_dropped, bitmap) for every document row that loses a line; d is the id (LAST_ID for null),
    r a hash of the whole text. Bit i of the bitmap, from the highest bit of each byte, is 1 if line i stays."""
    spark = docs.sparkSession
    lines = _keyed(docs, id_col, text_col).select("d", "r", F.split("text", "\n").alias("lines"))
    lines = lines.select("d", "r", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(BLANK)), UPPER, LOWER)
    lines = lines.select("d", "r", "n", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    rows = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "d", "r", "pos", "n")
    rows = materialize(rows, "lines")  # dealing by range reads its input twice, and texts are to be read once
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "h1", "h2", "d", "r", "pos").sortWithinPartitions("h1", "h2", "d", "r", "pos")
    dealt = dealt.checkpoint().withColumn("p", F.spark_partition_id())
    release(rows)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = tail = None
        for b in batches:
            if not len(b):
                continue
            h1, h2, d = (b[c].to_numpy() for c in ("h1", "h2", "d"))
            if head is None:
                head = (int(b["p"].iloc[0]), int(h1[0]), int(h2[0]))
            start = int(np.flatnonzero((h1 == h1[-1]) & (h2 == h2[-1]))[0])
            if tail is None or tail[:2] != (int(h1[-1]), int(h2[-1])):
                tail = (int(h1[-1]), int(h2[-1]), int(d[start]))
        if head is not None:
            yield pd.DataFrame([head + tail], columns=["p", "f1", "f2", "l1", "l2", "d"])

    summary = dealt.select("h1", "h2", "d", "p").mapInPandas(ends, "p int, f1 long, f2 long, l1 long, l2 long, d long")
    carry: dict[int, tuple[int, int, int]] = {}
    before = None  # the last line of the partitions so far, and its first document
    for x in sorted(summary.collect()):  # one row per partition
        if before is not None and before[:2] == (x.f1, x.f2):
            carry[x.p] = before
        if before is None or before[:2] != (x.l1, x.l2):
            before = (x.l1, x.l2, x.d)

    def later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for b in batches:
            if not len(b):
                continue
            h1, h2, d = (b[c].to_numpy() for c in ("h1", "h2", "d"))
            if state is None:
                state = carry.get(int(b["p"].iloc[0]), (0, 0, None))
            new = np.ones(len(b), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = state[2] is None or (int(h1[0]), int(h2[0])) != state[:2]
            starts = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
            first = np.where(starts >= 0, d[np.maximum(starts, 0)], state[2] if state[2] is not None else 0)
            state = (int(h1[-1]), int(h2[-1]), int(first[-1]))
            goes = d != first
            if goes.any():
                yield b.loc[goes, ["d", "r", "pos", "n"]]

    dropped = dealt.mapInPandas(later, "d long, r long, pos int, n int")
    # rows equal in id and text share their positions
    per_doc = dropped.groupBy("d", "r").agg(F.first("n").alias("n"), F.collect_set("pos").alias("positions"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            maps = []
            for n, positions in zip(b["n"], b["positions"]):
                keep = np.ones(n, np.uint8)
                keep[np.asarray(positions)] = 0
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pd.DataFrame({"d": b["d"], "r": b["r"], "n_lines": b["n"], "n_dropped": [len(x) for x in b["positions"]], "bitmap": maps})

    return per_doc.mapInPandas(pack, "d long, r long, n_lines long, n_dropped long, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): every document row with the lines that its bitmap keeps."""
    rows = _keyed(docs, id_col, text_col).join(bitmaps.select("d", "r", "n_dropped", "bitmap"), ["d", "r"], "left")

    @F.pandas_udf("string")
    def kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(text, bitmap):
            if m is None:
                out.append(t)
                continue
            lines = t.split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(m), np.uint8), count=len(lines))
            out.append("\n".join(x for x, k in zip(lines, keep.tolist()) if k))
        return pd.Series(out, dtype=object)

    return rows.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept("text", "bitmap").alias("kept_text"))
