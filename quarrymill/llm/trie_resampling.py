"""Target-distribution importance resampling: hashed runs of words, weighed by a target's and all documents' bucket shares, drawn by Gumbel scores.

Workers lay the runs of 1 to `n` words of their part of the documents down in a trie: a node is a run, it holds how often the run
occurred and the state of the CRC after its bytes, from which its children's states follow without hashing the run again. A trie
that has reached `max_nodes` after a text is added up by bucket and begun anew; a part ends as one array of bucket totals. Totals of all parts make a gain per
bucket (as many numbers as there are buckets, a parameter), and a second walk through tries whose nodes hold gains scores the documents.

The draw is exact: scores are dealt by range over (score, id), every range knows how many rows stand before it, and ranks are counted
within ranges, so no task sees more than its range and equal scores never meet in one task for being equal.

Defined cases: null text has no words, a document without words has weight 0. A null id counts as the text '' in the draw and comes
after all ids; rows that repeat an id are drawn one by one, in any order among themselves. An empty table gives an empty result; with an empty target
every t is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, column, materialize, release, require

#: A-Z are lower-cased before; bytes from 0x80 on belong to characters beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Trie:
    """Runs of words. A node is a list: CRC state after the run, value (a count or a gain), children by word."""

    __slots__ = ("n", "nodes", "root", "spaced")

    def __init__(self, n: int):
        self.n, self.nodes, self.root, self.spaced = n, 0, {}, {}

    def child(self, node: list | None, word: bytes) -> list:
        """A new node below `node` (None: the root), with value 0."""
        self.nodes += 1
        if node is None:
            new = self.root[word] = [zlib.crc32(word), 0, None]
            return new
        if node[2] is None:
            node[2] = {}
        new = node[2][word] = [zlib.crc32(word, zlib.crc32(b" ", node[0])), 0, None]
        return new

    def all(self) -> Iterator[list]:
        level = list(self.root.values())
        while level:
            yield from level
            level = [c for x in level if x[2] for c in x[2].values()]

    def add(self, words: list[bytes]) -> None:
        """Counts every run of the document."""
        root, n = self.root, self.n
        for i, word in enumerate(words):
            node = root.get(word) or self.child(None, word)
            node[1] += 1
            for word in words[i + 1 : i + n]:
                node = (node[2] and node[2].get(word)) or self.child(node, word)
                node[1] += 1

    def total(self, words: list[bytes], gains: list[int]) -> int:
        """The sum of the gains of every run of the document; new nodes get theirs by their CRC."""
        root, n, buckets, out = self.root, self.n, len(gains), 0
        for i, word in enumerate(words):
            node = root.get(word)
            if node is None:
                node = self.child(None, word)
                node[1] = gains[node[0] % buckets]
            out += node[1]
            for word in words[i + 1 : i + n]:
                found = node[2] and node[2].get(word)
                if not found:
                    found = self.child(node, word)
                    found[1] = gains[found[0] % buckets]
                node = found
                out += node[1]
        return out


def runs(words: int, n: int) -> int:
    """Number of runs of 1 to n among so many words."""
    return sum(max(0, words - k) for k in range(n))


def bucket_totals(texts: DataFrame, n: int, buckets: int, max_nodes: int) -> DataFrame:
    """(bucket, c) of the buckets that occur; texts has one column `text`."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, trie = np.zeros(buckets, np.int64), Trie(n)

        def fold() -> None:
            data = np.fromiter((x for node in trie.all() for x in node[:2]), np.int64).reshape(-1, 2)
            np.add.at(totals, data[:, 0] % buckets, data[:, 1])

        for b in batches:
            for text in b["text"]:
                trie.add(words_of(text))
                if trie.nodes >= max_nodes:
                    fold()
                    trie = Trie(n)
        fold()
        at = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": at, "c": totals[at]})

    return texts.mapInPandas(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))


def bucket_gains(documents: DataFrame, target: DataFrame, n: int, buckets: int, max_nodes: int) -> list[int]:
    """Of each bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), with s of S features in the documents and t of T in the target."""
    s, t = (bucket_totals(x, n, buckets, max_nodes).withColumnRenamed("c", name) for x, name in ((documents, "s"), (target, "t")))
    both = s.join(t, "bucket", "full").select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in "st"))
    found = {r.bucket: (r.s, r.t) for r in both.collect()}  # a row per bucket at most
    total_s, total_t = (sum(x[i] for x in found.values()) for i in (0, 1))
    pairs = (found.get(b, (0, 0)) for b in range(buckets))
    return [math.floor(1000 * math.log((t + 1.0) * (total_s + buckets) / ((s + 1.0) * (total_t + buckets)))) for s, t in pairs]


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """scored with the rank of the `drawn` highest scores among its rows that are `eligible`, ties by doc_id (null last); others have null.
    scored is read several times and should be a written table."""
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.coalesce("doc_id", F.lit(LAST_ID)), F.col("row")]
    dealt = scored.where("eligible").withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    # written, so that ranges stay what they are whatever is worked out again
    dealt = materialize(dealt.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "resampling-ranges")
    sizes = {r.part: r.n for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    before, at = {}, 0
    for p in sorted(sizes):
        before[p], at = at, at + sizes[p]
    offsets = dealt.sparkSession.createDataFrame([(p, k) for p, k in before.items() if k < drawn] or [(-1, 0)], "part int, before long")
    within = Window.partitionBy("part").orderBy(*order)
    near = dealt.join(F.broadcast(offsets), "part")  # ranges behind the draw take no part
    places = near.withColumn("rank", F.col("before") + F.row_number().over(within))
    won = places.where(F.col("rank") <= drawn)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    beyond = F.lit(None).cast("long").alias("rank")
    lost = [
        scored.where("NOT eligible").select(*names[:-1], beyond),
        places.where(F.col("rank") > drawn).select(*names[:-1], beyond),
        dealt.join(F.broadcast(offsets), "part", "left_anti").select(*names[:-1], beyond),
    ]
    out = won.select(*names)
    for x in lost:
        out = out.unionByName(x)
    return out


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000,
    percent: int = 10, least_words: int = 20, seed: int = 2024, max_nodes: int = 500_000,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs: the number of its runs, the floored mean of their gains, that mean with Gumbel
    noise of the id, and its place among the floor(percent * N / 100) drawn of the N rows with at least least_words words."""
    require(docs, id_col, text_col)
    require(target, target_text)
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    gains = bucket_gains(rows.select("text"), target.select(column(target, target_text).cast("string").alias("text")), n, buckets, max_nodes)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = Trie(n)
        for b in batches:
            out = []
            for text in b:
                words = words_of(text if isinstance(text, str) else None)
                k = runs(len(words), n)
                out.append((len(words), k, trie.total(words, gains) // k if k else 0))
                if trie.nodes >= max_nodes:
                    trie = Trie(n)
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = rows.select("doc_id", weigh("text").alias("w"), noise.alias("noise"))
    scored = weighed.select("doc_id", F.col("w.n_features").alias("n_features"), F.col("w.weight").alias("weight"), (F.col("w.weight") + F.col("noise")).alias("score"), (F.col("w.n_words") >= least_words).alias("eligible"))
    scored = materialize(scored, "resampling-scores")
    drawn = percent * scored.where("eligible").count() // 100
    return ranked(scored, drawn)
