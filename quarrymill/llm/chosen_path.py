"""Jaccard join of documents on word n-grams by the chosen-path method.

A document is the set of its five-word shingles (lower-cased words between white space). Documents with equal sets
are one class of copies from here on. Every set gets `tokens` min-wise tokens; two sets of similarity s agree
in a sampled token with probability s.

A run splits all sets on the values of sampled tokens, three to begin with. A bucket that is still larger than `bucket`
is split `branches` times, each time by another token that its path has not used, down to `depth` tokens. Small buckets
are compared by brute force on all tokens; in buckets that stay large their members are linked to the smallest one.
There are as many runs as let a pair at the threshold meet with probability `recall` even if its buckets
are large down to `depth`. Before a large bucket is split, its members are also compared with a
few pivots of it, so that one of a large group who is alone after the split still meets the group. A bucket whose members agree
with pivots that agree with one another, but for at most `strays` members, needs no split: the former are one candidate group, and the latter
are held against every member. So groups of near copies don't multiply; only buckets of unlike documents branch. What was linked is a
candidate group, and inside these groups all pairs are compared exactly on whole shingle sets: small groups in one task, larger ones block by
block, so no task holds more than two blocks. Pairs are counted where they are found and never
emitted; a task gives one row per set, its links and its root. The classes are the connected components of the
exact links.

Moved per run and set: a hash and a number. Whole texts move once, to join those of candidates. The sets of a group of m
different texts move m / block times, and their m^2 pairs are compared once: an exact number of
links asks for that. Copies cost nothing of this.

Defined cases: a text of fewer than five words is one shingle of all its words; a text without words is one
shingle of its own (so empty and null texts are copies of one another). A null id counts as the largest one. Rows
that repeat an id take part one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, WordHashes, column, materialize, release, require

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = text.lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(1, np.uint64)
    h = hashes.of(words)
    n = max(len(h) - width + 1, 1)
    with np.errstate(over="ignore"):
        s = np.full(n, min(len(h), width), np.uint64)
        for k in range(min(width, len(h))):
            s = (s ^ (s >> np.uint64(31))) * P1 + h[k : k + n]
        s = (s ^ (s >> np.uint64(29))) * P2
        s ^= s >> np.uint64(32)
    return np.unique(s)


def _multipliers(tokens: int) -> np.ndarray:
    return np.random.default_rng(41).integers(1, 2**63, tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(sets: list[np.ndarray], tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set: a 64-bit hash of all of it, and its min-wise tokens as 32-bit numbers."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), tokens), np.int32)
    with np.errstate(over="ignore"):
        for i, m in enumerate(_multipliers(tokens)):
            out[:, i] = (np.minimum.reduceat(flat * m, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        mixed = flat * P1
        mixed ^= mixed >> np.uint64(33)
        mixed *= P2
        key = np.add.reduceat(mixed, starts) + np.array([len(s) for s in sets], np.uint64) * P1
        key ^= key >> np.uint64(31)
        key *= P2
    return key.view(np.int64), out


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys of a sorted stream."""
    rest = None
    for b in batches:
        if rest is not None:
            b = pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        change = np.zeros(len(b), bool)
        for k in key:
            v = b[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for a, e in zip(cuts, cuts[1:]):
            yield b.iloc[a:e]
        rest = b.iloc[cuts[-1] :]
    if rest is not None and len(rest):
        yield rest


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): the smallest node it is connected to. Alternates large and small
    stars until nothing changes; a round moves each edge a few times and holds no component in one place."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = materialize(small, "components")
        state = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        release(now)
        now = new
        if state == mark or state[0] == 0:
            break
        mark = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def meeting(threshold: float, tokens: int, first_depth: int, depth: int, branches: int) -> list[tuple[float, float]]:
    """(probability that k of the tokens agree, probability that a run then keeps a pair together to `depth`) for every k."""
    out = []
    for k in range(tokens + 1):
        agree = lambda used, k=k: max(k - used, 0) / (tokens - used)
        lives = 1.0
        for used in reversed(range(first_depth, depth)):
            lives = 1 - (1 - agree(used) * lives) ** branches
        out.append((math.comb(tokens, k) * threshold**k * (1 - threshold) ** (tokens - k), math.prod(map(agree, range(first_depth))) * lives))
    return out


def runs_for(recall: float, threshold: float, tokens: int, first_depth: int, depth: int, branches: int, most: int = 1024) -> int:
    """How many runs let a pair at the threshold meet with that probability, however deep its buckets are split."""
    cases = meeting(threshold, tokens, first_depth, depth, branches)
    return next((n for n in range(1, most) if sum(w * (1 - p) ** n for w, p in cases) <= 1 - recall), most)


def _to_pivots(large: DataFrame, sets: DataFrame, pivots: int, tokens: int, least: float, strays: int, loose: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(u, v): links of members of large buckets to pivots that agree with them (in a share `loose` of the tokens; it only has to be below
    `least`, as what is linked is compared exactly later); and (path) of the buckets that are settled by that. Pivots are the smallest members by
    `pivots` hashes: picked with partial sums, and a bucket has no more than that many.

    The hub of a pivot is that pivot and those that agree with it. A bucket is settled by the hub that leaves the fewest members
    apart, if there are at most `strays` of these. All others are linked to the hub, so any pair of them is in one group; pivots outside the hub and members
    apart are held against every member of the bucket, so no pair of theirs is missed. In other buckets the first two links of
    each member count."""
    chosen = large.groupBy("path").agg(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(pivots)]).alias("p"))
    chosen = chosen.select("path", F.posexplode(F.array_distinct("p")).alias("place", "node")).join(sets.select("node", "signs"), "node")
    chosen = chosen.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "node", "signs"))).alias("p"))
    rows = large.select("path", "node").join(sets.select("node", "signs"), "node").join(chosen, "path")
    agree = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) >= math.ceil(min(least, loose) * tokens)
    names = F.transform("p", lambda q: q["node"])
    rows = rows.select("path", "node", names.alias("names"), F.transform("p", lambda q: agree(F.col("signs"), q["signs"])).alias("near"))
    rows = materialize(rows.withColumn("place", F.array_position("names", F.col("node"))), "join-pivots")  # 0: no pivot
    hubs = rows.where("place > 0").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "near"))), lambda q: q["near"]).alias("hubs"))
    both = lambda hub: F.exists(F.zip_with("near", hub, lambda x, y: x & y), lambda e: e)
    apart = [F.count(F.when((F.col("place") == 0) & ~F.coalesce(both(F.get("hubs", F.lit(k))), F.lit(False)), 1)) for k in range(pivots)]
    settled = rows.join(hubs, "path").groupBy("path", "hubs").agg(F.array(*apart).alias("apart"))
    settled = settled.where(F.array_min("apart") <= strays).withColumn("centre", F.array_position("apart", F.array_min("apart")).cast("int") - 1)
    settled = materialize(settled.select("path", "centre", F.get("hubs", "centre").alias("hub")), "join-settled")
    rows = rows.join(settled, "path", "left").withColumn("held", both("hub"))
    linked = F.filter(F.zip_with("names", "near", lambda n, y: F.when(y, n)), lambda n: n.isNotNull() & (n != F.col("node")))
    pick = lambda wanted: F.filter(F.zip_with("names", F.zip_with("near", "hub", wanted), lambda n, y: F.when(y, n)), lambda n: n.isNotNull())
    to_hub = F.when(F.col("place") > 0, F.when(F.col("held"), F.array(F.get("names", "centre")))).otherwise(F.slice(pick(lambda x, y: x & y), 1, 1))
    to_hub = F.concat(F.coalesce(to_hub, F.array().cast("array<bigint>")), pick(lambda x, y: x & ~y))
    edges = rows.select(F.col("node").alias("u"), F.explode(F.when(F.col("centre").isNull(), F.slice(linked, 1, 2)).otherwise(to_hub)).alias("v"))
    # members apart against all members; of those at the hub one link is enough
    lone = rows.where("centre is not null and place = 0 and not held").join(sets.select("node", "signs"), "node")
    lone = lone.groupBy("path").agg(F.collect_list(F.struct("node", "signs")).alias("lone"))
    beside = rows.where("centre is not null").select("path", "node", "held").join(lone, "path").join(sets.select("node", "signs"), "node")
    like = F.filter("lone", lambda q: (q["node"] != F.col("node")) & agree(F.col("signs"), q["signs"]))
    beside = beside.select("path", "node", "held", F.explode(F.transform(like, lambda q: q["node"])).alias("v"))
    beside = beside.groupBy("path", "v", F.when(~F.col("held"), F.col("node"))).agg(F.min("node").alias("u")).select("u", "v")
    return edges.where("u <> v").unionByName(beside), settled.select("path")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.9999, tokens: int = 64, pivots: int = 8,
    bucket: int = 64, first_depth: int = 3, depth: int = 10, block: int = 256, width: int = 5, branches: int = 2, strays: int = 64,
) -> DataFrame:
    """One row per row of docs: (doc_id, d, r, node, rep_id, class_id, n_links). d is the id (LAST_ID for null) and r a
    hash of the text; node stands for the shingle set, so rows of one node are copies, and rep_id is their smallest
    id; class_id is the smallest id of the class; n_links counts the other sets that are similar."""
    require(docs, id_col, text_col)
    up, down = int(round(threshold * 1000)), 1000
    rows = docs.select(F.coalesce(column(docs, id_col).cast("long"), F.lit(LAST_ID)).alias("d"), column(docs, text_col).cast("string").alias("text"))
    rows = rows.withColumn("r", F.xxhash64(F.coalesce("text", F.lit(""))))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(seed=1)
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.iloc[a : a + 256]
                key, signs = sketch([shingles(t, hashes, width) for t in part["text"]], tokens)
                yield pd.DataFrame({"d": part["d"].to_numpy(), "r": part["r"].to_numpy(), "node": key, "signs": list(signs)})

    described = materialize(rows.mapInPandas(describe, "d long, r long, node long, signs array<int>"), "join-sketch")
    sets = described.groupBy("node").agg(F.min(F.struct("d", "r")).alias("at"), F.first("signs").alias("signs"))
    sets = materialize(sets, "join-sets")

    # chosen paths
    depth = min(depth, tokens - branches + 1)
    runs = runs_for(recall, threshold, tokens, first_depth, depth, branches)
    rng = np.random.default_rng(43)
    order = [rng.permutation(tokens)[:first_depth].tolist() for _ in range(runs)]
    used = [F.array(*[F.lit(i + 1) for i in o]).alias("used") for o in order]
    paths = F.array(*[F.struct(used[k], F.xxhash64(F.lit(k), *[F.element_at("signs", i + 1) for i in o]).alias("path")) for k, o in enumerate(order)])
    active = sets.select("node", F.explode(paths).alias("p")).select("node", "p.used", "p.path")
    # the next tokens of a path: the same for all its members, none that it has used
    turn = lambda i: F.xxhash64("path", i)
    fresh = F.slice(F.array_sort(F.transform(F.array_except(F.sequence(F.lit(1), F.lit(tokens)), "used"), lambda i: F.struct(turn(i).alias("by"), i.alias("i")))), 1, branches)
    least = threshold - 4 * math.sqrt(threshold * (1 - threshold) / tokens)
    small, edges, level = None, None, first_depth
    while True:
        sizes = active.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
        sized = materialize(active.join(sizes, "path"), "join-level")
        ready = sized.where(F.col("n") <= bucket).select("path", "node")
        small = ready if small is None else small.unionByName(ready)
        large = sized.where(F.col("n") > bucket)
        if large.isEmpty():
            break
        linked, whole = _to_pivots(large, sets, pivots, tokens, least, strays)
        linked = materialize(linked.distinct(), "join-links")
        edges = linked if edges is None else edges.unionByName(linked)
        large = large.join(whole, "path", "left_anti")
        if level >= depth:
            edges = edges.unionByName(large.select(F.col("node").alias("u"), F.col("hub").alias("v")))
            break
        active = large.withColumn("next", F.explode(fresh)).join(sets.select("node", "signs"), "node")
        token = F.col("next")["i"]
        active = active.select("node", F.concat("used", F.array(token)).alias("used"), F.xxhash64("path", token, F.element_at("signs", token)).alias("path"))
        level += 1

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u, v = [], []
        for g in _groups(batches, ["path"]):
            node = np.unique(g["node"].to_numpy(), return_index=True)
            if len(node[0]) < 2:
                continue
            signs, node = np.stack(g["signs"].to_numpy()[node[1]]), node[0]
            forest = Forest(len(node))
            for i in range(1, len(node)):
                for j in np.flatnonzero((signs[:i] == signs[i]).mean(1) >= least).tolist():
                    forest.link(i, j)
            for i in range(len(node)):
                if forest.root(i) != i:
                    u.append(node[i])
                    v.append(node[forest.root(i)])
            if len(u) > 10_000:
                yield pd.DataFrame({"u": u, "v": v})
                u, v = [], []
        yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    met = small.join(sets.select("node", "signs"), "node").repartition("path").sortWithinPartitions("path")
    found = met.mapInPandas(brute, "u long, v long").distinct()
    group = materialize(components(found if edges is None else found.unionByName(edges)), "join-groups")

    # exact comparison inside the groups
    blocks = group.groupBy("root").agg(F.ceil(F.count("*") / block).alias("blocks"))
    members = group.join(blocks, "root").withColumn("b", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
    members = members.join(sets.select("node", "at.d", "at.r"), "node")
    texts = rows.join(members, ["d", "r"]).select("node", "root", "blocks", "b", "text")

    def whole_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(seed=1)
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "root": b["root"], "blocks": b["blocks"], "b": b["b"], "data": [shingles(t, hashes, width).tobytes() for t in b["text"]]})

    full = texts.mapInPandas(whole_sets, "node long, root long, blocks long, b long, data binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tasks = full.withColumn("o", other).select("node", "root", "blocks", "b", "data", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    tasks = tasks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["root", "i", "j"]):
            g = g.drop_duplicates("node")
            node, n = g["node"].to_numpy(), len(g)
            if n < 2:
                continue
            data = [np.frombuffer(x, np.uint64) for x in g["data"]]
            size = np.array([len(x) for x in data])
            common = intersections(data)
            alike = common * (down + up) >= up * (size[:, None] + size[None, :])
            np.fill_diagonal(alike, False)
            one = int(g["i"].iloc[0]) == int(g["j"].iloc[0])
            if not one:  # pairs inside a block are counted in the block's own task
                b = g["b"].to_numpy()
                alike &= b[:, None] != b[None, :]
            forest = Forest(n)
            for x, y in zip(*np.nonzero(np.triu(alike))):
                forest.link(int(x), int(y))
            yield pd.DataFrame({"node": node, "root": node[[forest.root(x) for x in range(n)]], "links": alike.sum(1), "whole": np.full(n, int(g["blocks"].iloc[0]) == 1)})

    exact = materialize(tasks.mapInPandas(compare, "node long, root long, links long, whole boolean"), "join-exact")
    links = exact.groupBy("node").agg(F.sum("links").alias("n_links"))
    # groups of one task have their components already
    split = components(exact.where("not whole").select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = exact.where("whole").select("node", "root").unionByName(split)
    known = links.join(known, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n_links")
    smallest = sets.select("node", F.col("at.d").alias("least")).join(known, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of_class = smallest.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = smallest.join(of_class, "root").select("node", F.col("least").alias("rep_id"), "class_id", "n_links")
    out = described.select("d", "r", "node").join(classes, "node")
    return out.select(F.when(F.col("d") != LAST_ID, F.col("d")).alias("doc_id"), "d", "r", "node", "rep_id", "class_id", "n_links")


def intersections(data: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs, by matrix products over slices of the shingles that occur twice."""
    n = len(data)
    flat = np.concatenate(data)
    row = np.repeat(np.arange(n), [len(x) for x in data])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float64)
    for a in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(column, [a, a + columns])
        m = np.zeros((n, min(columns, int(shared.sum()) - a)), np.float32)
        m[row[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = [len(x) for x in data]
    return np.rint(out).astype(np.int64)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of every class, the one with the smallest id; columns as they were."""
    found = near_duplicates(docs, id_col, text_col, **options)
    stay = found.groupBy("class_id").agg(F.min(F.struct("d", "r")).alias("at")).select(F.col("at.d").alias("_d"), F.col("at.r").alias("_r"))
    # the row goes along as one column, so that no name in it can clash
    row, d = F.struct(*[column(docs, c).alias(c) for c in docs.columns]).alias("_doc"), F.coalesce(column(docs, id_col).cast("long"), F.lit(LAST_ID)).alias("_d")
    mine = docs.select(row, d, F.xxhash64(F.coalesce(column(docs, text_col).cast("string"), F.lit(""))).alias("_r"))
    one = mine.join(stay, ["_d", "_r"]).dropDuplicates(["_d", "_r"])
    return one.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
