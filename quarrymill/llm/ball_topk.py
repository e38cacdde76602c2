"""Exact top-k by integer inner product: one ball tree per shard, searched by branch and bound.

Rows are dealt to shards by a hash of their number; each shard becomes one row that holds its ball tree. Queries
travel in blocks. Every block first searches the shard it comes from, which gives each query a k-th score that the
full answer cannot fall below. Then blocks visit the other shards in rounds that grow eightfold; before each
round the answers so far are merged, so every round prunes by the k-th score over all shards seen up to then. In a tree,
nodes are visited in order of their upper bound q.c + |q| r, and a node is skipped for every query whose
k-th score lies above the bound. Ties at the k-th score are visited, as the smaller id wins.

The blocks that visit a shard are dealt to chunks of about `chunk_blocks`. A group is one tree and one chunk, so a tree
travels once per chunk, and no group grows with the number of queries. Answers are merged 64 shards at a time.

Defined cases: vectors that are null or hold null or non-finite components take no part; an empty vector does, with
scores of 0. Vectors of unequal length are taken as padded with zeros. Every other row is a candidate, rows that repeat
the query's id included; a query never finds its own row. Null ids are no queries, but candidates that sort after all
others (2^63 - 1 stands for them and is reported as null). Fewer than k candidates: all of them. Components are
exact up to 2^62, scores are exact integers; a component or a score beyond that range is an error.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, materialize, release, require

LEAF = 64
NONE = np.iinfo(np.int64).min


def _matrix(rows: list) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def build_tree(ids: np.ndarray, vectors: np.ndarray, numbers: np.ndarray | None = None) -> dict:
    """Nodes as arrays; a node covers rows start..end of the reordered integer vectors. numbers: of the rows (default 0, 1, ...)."""
    numbers = np.arange(len(ids)) if numbers is None else numbers
    vectors = vectors.astype(np.int64)
    real = vectors.astype(np.float64)
    order = np.arange(len(ids))
    centre, radius, start, end, left, right = [], [], [], [], [], []

    def add(a: int, b: int) -> int:
        x = real[order[a:b]]
        c = x.mean(0)
        centre.append(c)
        radius.append(float(np.sqrt(((x - c) ** 2).sum(1).max())))
        for column, v in ((start, a), (end, b), (left, -1), (right, -1)):
            column.append(v)
        return len(centre) - 1

    work = [add(0, len(ids))] if len(ids) else []
    while work:
        n = work.pop()
        a, b = start[n], end[n]
        if b - a <= LEAF or radius[n] == 0:
            continue
        x = real[order[a:b]]
        far = x[((x - centre[n]) ** 2).sum(1).argmax()]
        other = x[((x - far) ** 2).sum(1).argmax()]
        side = np.argsort(x @ (other - far), kind="stable")
        order[a:b] = order[a:b][side]
        m = (a + b) // 2
        left[n], right[n] = add(a, m), add(m, b)
        work += [left[n], right[n]]
    return {"ids": ids[order], "rows": numbers[order], "x": vectors[order], "c": np.array(centre), "r": np.array(radius), "s": start, "e": end, "l": left, "g": right}


def _largest(m: np.ndarray) -> float:
    return float(np.abs(m.astype(np.float64)).max(initial=0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows. Doubles hold every partial sum below 2^53; beyond that 64-bit
    integers are exact modulo 2^64, so they are right where the result fits, which doubles tell."""
    if _largest(q) * _largest(x) * max(q.shape[1], 1) < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    near = q.astype(np.float64) @ x.astype(np.float64).T
    slack = 1e-9 * (np.abs(q.astype(np.float64)) @ np.abs(x.astype(np.float64)).T)
    if (np.abs(near) + slack >= 2.0**63).any():
        # doubles can't decide near the limit: Python's integers can
        exact = q.astype(object) @ x.astype(object).T
        if (np.abs(exact) >= 2**63).any():
            raise OverflowError("a score needs more than 64 bits")
        return exact.astype(np.int64)
    with np.errstate(over="ignore"):
        return q @ x.T


def merge(best: np.ndarray, best_id: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both sides by row: highest score, then smallest id. NONE is no score."""
    both, both_id = np.concatenate([best, scores], 1), np.concatenate([best_id, ids], 1)
    by = np.lexsort((both_id, ~both), axis=1)[:, :k]
    return np.take_along_axis(both, by, 1), np.take_along_axis(both_id, by, 1)


def nothing(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), NONE), np.full((n, k), LAST_ID)


def search_tree(tree: dict, q: np.ndarray, q_rows: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (nq, k) of the best of this tree that reach floor; missing places hold NONE. q_rows: the numbers of
    the queries' own rows, which they don't find."""
    nq = len(q_rows)
    best, best_id = nothing(nq, k)
    if not len(tree["ids"]) or not nq:
        return best, best_id
    dim = max(q.shape[1], tree["x"].shape[1])
    pad = lambda m: m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))
    x, c, q = pad(tree["x"]), pad(tree["c"]), pad(q)
    kth = floor.copy()
    real = q.astype(np.float64)
    norm = np.sqrt((real * real).sum(1))
    reach = norm[:, None] * (tree["r"] + np.sqrt((c * c).sum(1)))[None, :]
    bounds = real @ c.T
    bounds += norm[:, None] * tree["r"][None, :]
    bounds += 1e-9 * reach + 1e-6  # more than what rounding can take away
    heap = [(-float(bounds[:, 0].max()), 0)]
    while heap:
        _, n = heapq.heappop(heap)
        rows = np.flatnonzero(bounds[:, n] >= kth)
        if not len(rows):
            continue
        if tree["l"][n] >= 0:
            for child in (tree["l"][n], tree["g"][n]):
                heapq.heappush(heap, (-float(bounds[rows, child].max()), child))
            continue
        a, b = tree["s"][n], tree["e"][n]
        scores = products(q[rows], x[a:b])
        scores[q_rows[rows][:, None] == tree["rows"][a:b][None, :]] = NONE
        hit = scores.max(1) >= np.maximum(kth[rows], NONE + 1)
        if not hit.any():
            continue
        rows, scores = rows[hit], scores[hit]
        best[rows], best_id[rows] = merge(best[rows], best_id[rows], scores, np.broadcast_to(tree["ids"][a:b], scores.shape), k)
        kth[rows] = np.maximum(kth[rows], best[rows, k - 1])
    return best, best_id


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, query_every: int = 20,
    shard_rows: int = 8192, block_rows: int = 512, chunk_blocks: int = 64, fan: int = 64,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by query_every, its k best by floor(scale * x)."""
    require(vectors, id_col, vector_col)
    x = F.col("v")
    ok = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).where(ok)
    floors = F.transform("v", lambda e: F.when(F.abs(e * scale) < 2.0**62, F.floor(e * scale)).otherwise(F.raise_error(F.lit("a component needs more than 62 bits")).cast("long")))
    asked = F.col("id").isNotNull() & (F.col("id") % query_every == 0)
    # written once, so that a row keeps its number whatever is worked out again
    numbered = whole.select(F.coalesce("id", F.lit(LAST_ID)).alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), floors.alias("v"), F.monotonically_increasing_id().alias("row"))
    numbered = materialize(numbered, "topk-rows")
    shards = max(1, -(-numbered.count() // shard_rows))
    chunks = max(1, -(-numbered.where("asked").count() // (block_rows * chunk_blocks)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        asked, ids, rows, m = pdf["asked"].to_numpy(bool), pdf["id"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64), _matrix(list(pdf["v"]))
        tree, home = build_tree(ids, m, rows), int(pdf["shard"].iloc[0])
        out = [(home, -1, pickle.dumps(tree), None, None)]
        for n, a in enumerate(range(0, int(asked.sum()), block_rows)):
            mine = tuple(y[asked][a : a + block_rows] for y in (ids, rows, m))
            best = search_tree(tree, mine[2], mine[1], k, np.full(len(mine[0]), NONE))
            out.append((home, n, pickle.dumps(mine), pickle.dumps(best), best[0][:, k - 1].tobytes()))
        return pd.DataFrame(out, columns=["home", "block", "data", "best", "floor"])

    schema = "home int, block int, data binary, best binary, floor binary"
    dealt = numbered.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    made = materialize(dealt.groupBy("shard").applyInPandas(build, schema), "topk-index")
    release(numbered)
    trees = made.where("block < 0").select(F.col("home").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(-1).alias("home"), F.lit(-1).alias("block"), F.lit(0).alias("step"), "data", "floor")
    blocks = made.where("block >= 0")

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        out, tree = [], None
        for row in pdf.sort_values("block", kind="stable").itertuples(index=False):
            if row.block < 0:
                tree = pickle.loads(row.data)
                continue
            _, q_rows, q = pickle.loads(row.data)
            best, best_id = search_tree(tree, q, q_rows, k, np.frombuffer(row.floor, np.int64))
            at, place = np.nonzero(best != NONE)
            if len(at):
                out.append((row.home, row.block, row.step, pickle.dumps((at.astype(np.int32), best[at, place], best_id[at, place]))))
        return pd.DataFrame(out, columns=["home", "block", "step", "hits"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row for all hits of a block: the k best of each query among them."""
        at, score, found = (np.concatenate(y) for y in zip(*map(pickle.loads, pdf["hits"])))
        order = np.lexsort((found, ~score, at))
        at, score, found = at[order], score[order], found[order]
        place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        keep = place < k
        return pd.DataFrame({"home": pdf["home"].iloc[:1], "block": pdf["block"].iloc[:1], "step": pdf["step"].iloc[:1] // fan, "hits": [pickle.dumps((at[keep], score[keep], found[keep]))]})

    def combine(key: tuple, state: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        best, best_id = pickle.loads(state["best"].iloc[0])
        for data in hits["hits"]:
            at, score, found = pickle.loads(data)
            place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
            more, more_id = nothing(*best.shape)
            more[at, place], more_id[at, place] = score, found
            best, best_id = merge(best, best_id, more, more_id, k)
        return state.assign(best=[pickle.dumps((best, best_id))], floor=[best[:, k - 1].tobytes()])

    done = 1
    while done < shards:
        end = min(done * 8, shards)
        step = F.explode(F.sequence(F.lit(done), F.lit(end - 1)))
        going = blocks.select("home", "block", step.alias("step"), "data", "floor").withColumn("chunk", F.pmod(F.xxhash64("home", "block"), F.lit(chunks)).cast("int"))
        going = going.withColumn("shard", ((F.col("home") + F.col("step")) % shards).cast("int")).select(trees.columns)
        hits = going.unionByName(trees).groupBy("shard", "chunk").applyInPandas(visit, "home int, block int, step int, hits binary")
        left = end - done
        while left > 0:
            hits = hits.groupBy("home", "block", F.floor(F.col("step") / fan)).applyInPandas(gather, "home int, block int, step int, hits binary")
            left //= fan
        blocks = materialize(blocks.groupBy("home", "block").cogroup(hits.groupBy("home", "block")).applyInPandas(combine, schema), "topk-round")
        done = end

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data, best in zip(b["data"], b["best"]):
                q_ids, (score, found) = pickle.loads(data)[0], pickle.loads(best)
                at, place = np.nonzero(score != NONE)
                yield pd.DataFrame({"query_id": q_ids[at], "rank": place + 1, "vec_id": found[at, place], "score": score[at, place]})

    out = blocks.select("data", "best").mapInPandas(unpack, "query_id long, rank int, vec_id long, score long")
    return out.withColumn("vec_id", F.when(F.col("vec_id") != LAST_ID, F.col("vec_id")))
