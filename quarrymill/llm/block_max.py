"""Ranked lexical search: forward-index blocks of document ranges, visited in the order of their bounds until none can reach the k-th score.

Workers cut the documents, in the order they are read, into blocks of `block_rows` and write shards of blocks. A shard row holds
its terms with document frequencies, for each block and term the (occurrences, length) pairs that no other document of the block beats in both
(whatever the collection's statistics turn out to be, one of them has the block's largest score of the term), and the blocks themselves,
compressed one by one, as documents with their terms.

A search takes statistics from the shards' terms, then visits shards in three rounds (1/64 of them, 1/8, the rest), each of which starts from the
k-th scores of the round before. Within a shard a query adds up its terms' maxima to a bound per block, sorts the blocks by it
and scores block after block until the bound falls below its k-th score (or meets it with larger ids only); blocks that no query reaches are
never unpacked. A task hands on at most k rows per query. Queries travel in chunks of at most `chunk_terms` terms and `chunk_queries` queries,
with one pass of the rounds each, so what the driver and a task hold of them is bounded; nothing of the documents but statistics of a chunk's terms
and k-th scores reaches the driver.

Scores are exact integers: with N documents that have a term, L terms in all, n in the document, df and tf of the term,
w = floor(1000 ln((2N + 2) / (2df + 1))), m = 25 + 75nN div L, and a document's score is the sum of w (10^9 tf div (1000 tf + 8m)) over the query's terms.

Defined cases: null and empty texts have no terms; they are no candidates, and as queries they have no rows. Queries with less than k documents above
0 have fewer rows. Rows that repeat an id are documents or queries of their own. Null ids of documents sort after all others (2^63 - 1 stands
for them). Empty tables give an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, column, materialize, require

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
INDEX = "round int, docs long, words long, terms binary, df binary, maxima binary, blocks array<binary>"


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if isinstance(text, str) else []


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(pickle.dumps(arrays), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zlib.decompress(data))


def frontier(term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the postings that no other posting of their term beats by more occurrences in a text that is no longer; sorted by term."""
    order = np.lexsort((-tf, n, term))
    level = term[order].astype(np.int64) << 32 | tf[order]  # grows from term to term
    most = np.maximum.accumulate(level)
    return order[np.append(True, level[1:] > most[:-1])[: len(order)]]


class ShardWriter:
    """The documents of one shard, until there are enough of them."""

    def __init__(self, block_rows: int):
        self.block_rows, self.ids, self.docs, self.postings = block_rows, {}, [], 0

    def add(self, doc_id: int, words: list[bytes]) -> None:
        found = Counter(words)
        ids = self.ids
        numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int32, len(found))
        self.docs.append((doc_id, len(words), numbers, np.fromiter(found.values(), np.int64, len(found))))
        self.postings += len(found)

    def row(self) -> tuple[int, int, bytes, bytes, bytes, list[bytes]]:
        df, maxima, blocks = np.zeros(len(self.ids), np.int64), [], []
        for b, a in enumerate(range(0, len(self.docs), self.block_rows)):
            docs = self.docs[a : a + self.block_rows]
            doc_ids, n = (np.array([d[i] for d in docs], np.int64) for i in (0, 1))
            counts = np.array([len(d[2]) for d in docs])
            term, tf = (np.concatenate([d[i] for d in docs]) for i in (2, 3))
            df += np.bincount(term, minlength=len(df))
            lengths = np.repeat(n, counts)
            top = frontier(term, tf, lengths)
            maxima.append((np.full(len(top), b), term[top], tf[top], lengths[top]))
            blocks.append(_pack(doc_ids, n, counts.astype(np.int32), term, tf.astype(np.min_scalar_type(int(tf.max())))))
        small = (np.int16, np.int32, np.int64, np.int64)
        packed = _pack(*(np.concatenate(x).astype(t) for x, t in zip(zip(*maxima), small)), np.array([min(d[0] for d in self.docs[a : a + self.block_rows]) for a in range(0, len(self.docs), self.block_rows)]))
        return len(self.docs), sum(d[1] for d in self.docs), zlib.compress(b" ".join(self.ids), 1), _pack(df), packed, blocks


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 128, shard_blocks: int = 32, shard_postings: int = 2_000_000) -> DataFrame:
    """The shards, written to the shared folder."""
    require(docs, id_col, text_col)
    rows = docs.select(F.coalesce(column(docs, id_col).cast("long"), F.lit(LAST_ID)).alias("d"), column(docs, text_col).cast("string").alias("text"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = ShardWriter(block_rows)

        def done() -> pd.DataFrame:
            return pd.DataFrame([(0, *shard.row())], columns=["round", "docs", "words", "terms", "df", "maxima", "blocks"])

        for b in batches:
            for doc_id, text in zip(b["d"].tolist(), b["text"]):
                words = terms_of(text)
                if words:
                    shard.add(doc_id, words)
                    if len(shard.docs) >= block_rows * shard_blocks or shard.postings >= shard_postings:
                        yield done()
                        shard = ShardWriter(block_rows)
        if shard.docs:
            yield done()

    lot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(64))
    shards = rows.mapInPandas(write, INDEX).withColumn("round", F.when(lot < 1, 0).when(lot < 8, 1).otherwise(2))
    return materialize(shards.select("docs", "words", "terms", "df", "maxima", "blocks", "round"), "search-index", partition_by="round")


class Queries:
    """A chunk of queries: terms and weights laid end to end."""

    def __init__(self, rows: list):
        """rows: (terms, counts) per query."""
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(t for r in rows for t in r[0]))}
        self.starts = np.cumsum([0, *(len(r[0]) for r in rows)])
        self.term = np.array([self.terms[t] for r in rows for t in r[0]], np.int64)
        self.count = np.array([c for r in rows for c in r[1]], np.int64)
        self.weight = self.count

    def weigh(self, df: dict[int, int], docs: int) -> None:
        w = [math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.terms))]
        self.weight = self.count * np.array(w, np.int64)[self.term]

    def __len__(self) -> int:
        return len(self.starts) - 1


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    tf, n = tf.astype(np.int64), n.astype(np.int64)
    if 75 * int(n.max(initial=0)) * docs >= 2**63:
        m = np.array([25 + 75 * x * docs // words for x in n.tolist()], np.int64)
    else:
        m = 25 + 75 * n * docs // words
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def merge(score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((doc, -score))[:k]
    return score[by], doc[by]


class Search:
    """The best documents of a chunk's queries among the shards of one task."""

    def __init__(self, queries: Queries, docs: int, words: int, k: int, kth: np.ndarray, kth_doc: np.ndarray):
        """kth, kth_doc: the last of each query's k best so far; 0 where there are fewer."""
        self.q, self.docs, self.words, self.k = queries, docs, words, k
        self.kth, self.kth_doc = kth.copy(), kth_doc.copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        self.unpacked = self.scored = 0

    def bounds(self, numbers: np.ndarray, maxima: bytes, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, blocks): no document of the block has a higher score. And the blocks' smallest ids."""
        block, term, tf, n, least = _unpack(maxima)
        term = numbers[term]
        asked = term >= 0
        most = np.zeros((len(self.q.terms), blocks), np.int64)
        np.maximum.at(most, (term[asked], block[asked]), impacts(tf[asked], n[asked], self.docs, self.words))
        return np.add.reduceat(most[self.q.term] * self.q.weight[:, None], self.q.starts[:-1], axis=0), least

    def shard(self, terms: bytes, maxima: bytes, blocks: list[bytes]) -> None:
        numbers = np.array([self.q.terms.get(t, -1) for t in zlib.decompress(terms).split(b" ")], np.int64)
        if (numbers < 0).all():
            return
        bounds, least = self.bounds(numbers, maxima, len(blocks))
        order = np.argsort(-bounds, axis=1, kind="stable")
        going, opened = np.arange(len(self.q)), {}
        weights = np.zeros(len(self.q.terms), np.int64)
        for place in range(len(blocks)):
            at = order[going, place]
            bound = bounds[going, at]
            going = going[(bound > 0) & (bound >= self.kth[going])]
            for q in going.tolist():
                b = int(order[q, place])
                if bounds[q, b] < self.kth[q] or (bounds[q, b] == self.kth[q] and least[b] > self.kth_doc[q]):
                    continue
                if b not in opened:
                    opened[b] = self.open(numbers, blocks[b])
                a, e = self.q.starts[q], self.q.starts[q + 1]
                weights[self.q.term[a:e]] = self.q.weight[a:e]
                self.score(q, weights, *opened[b])
                weights[self.q.term[a:e]] = 0

    def open(self, numbers: np.ndarray, data: bytes) -> tuple[np.ndarray, ...]:
        """Of a block: ids of the documents with a term that a query asks for, where their postings of such terms begin, terms, impacts."""
        doc_ids, n, counts, term, tf = _unpack(data)
        self.unpacked += 1
        term = numbers[term]
        asked = term >= 0
        doc = np.repeat(np.arange(len(counts)), counts)[asked]
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
        return doc_ids[doc[starts]], starts, term[asked], impacts(tf[asked], n[doc], self.docs, self.words)

    def score(self, q: int, weights: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        self.scored += 1
        scores = np.add.reduceat(weights[term] * impact, starts) if len(starts) else np.zeros(0, np.int64)
        hit = (scores > 0) & ((scores > self.kth[q]) | ((scores == self.kth[q]) & (doc_ids <= self.kth_doc[q])))
        if hit.any():
            known = self.best[q]
            best = self.best[q] = merge(np.concatenate([known[0], scores[hit]]), np.concatenate([known[1], doc_ids[hit]]), self.k)
            if len(best[0]) == self.k and (best[0][-1], -best[1][-1]) > (self.kth[q], -self.kth_doc[q]):
                self.kth[q], self.kth_doc[q] = best[0][-1], best[1][-1]

    def hits(self) -> pd.DataFrame:
        q = np.repeat(np.arange(len(self.q)), [len(s) for s, _ in self.best])
        score, doc = (np.concatenate([x[i] for x in self.best]) for i in (0, 1))
        return pd.DataFrame({"q": q, "d": doc, "score": score})


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "d"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _search_chunk(index: DataFrame, rows: list, k: int) -> DataFrame | None:
    """(q, d, score, rank) for the queries of rows, by their place in it; None where no document has a term."""
    queries = Queries([(r.terms, r.counts) for r in rows])

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(len(queries.terms), np.int64)
        for b in batches:
            for terms, df in zip(b["terms"], b["df"]):
                numbers = np.array([queries.terms.get(t, -1) for t in zlib.decompress(terms).split(b" ")], np.int64)
                out[numbers[numbers >= 0]] += _unpack(df)[0][numbers >= 0]
        at = np.flatnonzero(out)
        yield pd.DataFrame({"t": at, "df": out[at]})

    docs, words = index.agg(F.sum("docs"), F.sum("words")).first()
    if not docs:
        return None
    df = index.select("terms", "df").mapInPandas(frequencies, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    queries.weigh({r.t: r.df for r in df.collect()}, docs)  # a row per term of the chunk
    kth, kth_doc = np.zeros(len(queries), np.int64), np.full(len(queries), LAST_ID)

    def searcher(kth: np.ndarray, kth_doc: np.ndarray):  # noqa: ANN202
        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            search = Search(queries, docs, words, k, kth, kth_doc)
            for b in batches:
                for terms, maxima, blocks in zip(b["terms"], b["maxima"], b["blocks"]):
                    search.shard(terms, maxima, list(blocks))
            yield search.hits()

        return visit

    best = None
    for n in range(3):
        hits = index.where(F.col("round") == n).select("terms", "maxima", "blocks").mapInPandas(searcher(kth.copy(), kth_doc.copy()), "q long, d long, score long")
        best = materialize(_best(hits if best is None else hits.unionByName(best.drop("rank")), k), "search-round")
        for r in best.where(F.col("rank") == k).collect():  # a row per query of the chunk
            kth[r.q], kth_doc[r.q] = r.score, r.d
    return best


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10, chunk_terms: int = 200_000, chunk_queries: int = 20_000) -> DataFrame:
    """(item_id, rank, doc_id, score): of each query the k documents with the highest scores above 0, ties by doc_id."""
    require(queries, id_col, text_col)
    kind = queries.schema[id_col].dataType
    asked = queries.select(F.monotonically_increasing_id().alias("row"), column(queries, id_col).alias("item_id"), column(queries, text_col).cast("string").alias("text"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(r, Counter(terms_of(t))) for r, t in zip(b["row"], b["text"])]
            yield pd.DataFrame([(r, list(c), list(c.values())) for r, c in found if c], columns=["row", "terms", "counts"])

    asked = materialize(asked, "search-queries")
    parsed = materialize(asked.select("row", "text").mapInPandas(parse, "row long, terms array<binary>, counts array<long>"), "search-terms")
    count, total = parsed.agg(F.count("*"), F.sum(F.size("terms"))).first()
    chunks = max(1, -(-(total or 0) // chunk_terms), -(-count // chunk_queries))
    out = asked.sparkSession.createDataFrame([], "row long, rank int, d long, score long")
    for c in range(chunks):
        rows = parsed.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == c).orderBy("row").collect()  # bounded by the chunk
        best = _search_chunk(index, rows, k) if rows else None
        if best is not None:
            numbers = asked.sparkSession.createDataFrame([(i, r.row) for i, r in enumerate(rows)], "q long, row long")
            out = out.unionByName(best.join(numbers, "q").select("row", "rank", "d", "score"))
    out = out.join(asked.select("row", "item_id"), "row")
    return out.select(F.col("item_id").cast(kind).alias("item_id"), "rank", F.when(F.col("d") != LAST_ID, F.col("d")).alias("doc_id"), "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """search() in an index of docs."""
    return search(build_index(docs), queries, k=k)
