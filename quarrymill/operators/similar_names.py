"""Similarity join of names within a place: the most similar names of a register for each of the names asked for.

Similarity is the larger of the indel ratio 2 LCS / (la + lb) and the share of common words. Names of a place fall into blocks of
at most about `block` by their hash; a task gets one block of either side, so a large place is a grid of tasks. Equal names are
compared once, and of equal names in the register only the `most` smallest keys can be among the best.

Within a task pairs are cut by bounds that the ratio can't exceed, worked out for a whole block at a time:
- lengths: LCS is at most the shorter one. The block is sorted by length, so this leaves one stretch of it;
- letters: LCS is at most the number of letters (with repeats) that both have;
- pairs of letters: every deletion destroys two of a name's letter pairs at most and every insertion one, so names with LCS c share
  at least 3c - la - lb - 1 of them. This says something above a ratio of 2/3: below, names can be that similar without sharing a pair;
- words: an inverted index counts common words exactly.
What is left is compared in the order of the bounds, in lots; once a name has `most` matches, their last one is the threshold.
LCS is worked out in words of bits for a whole lot at once.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import lcs_length

WORDS = 4  # of 64 bits each, for the letters and as many for the pairs of letters


def _bits(items: list[str]) -> tuple[np.ndarray, int]:
    """A set of bits for a multiset of strings, and by how many common bits can fall short of common strings."""
    out = np.zeros(WORDS, np.uint64)
    n = 0
    for item, k in Counter(items).items():
        for i in range(k):
            b = xxhash.xxh32_intdigest(f"{item}\0{i}") % (64 * WORDS)
            out[b >> 6] |= np.uint64(1 << (b & 63))
            n += 1
    return out, n - int(np.bitwise_count(out).sum())


def words_of(name: str) -> list[str]:
    return list(dict.fromkeys(w for w in name.split(" ") if w))


class NameIndex:
    """A block of the register's names."""

    def __init__(self, names: list[str], keys: list[str]):
        order = sorted(range(len(names)), key=lambda i: (len(names[i]), names[i], keys[i]))
        self.names, self.keys = [names[i] for i in order], np.array([keys[i] for i in order], object)
        self.length = np.array([len(n) for n in self.names], np.int64)
        self.letters, self.pairs = (np.zeros((len(order), WORDS), np.uint64) for _ in range(2))
        self.codes: dict[str, int] = {}
        self.text = np.zeros((int(self.length.max(initial=0)), len(order)), np.int32)
        listed: dict[str, list[int]] = defaultdict(list)
        known: dict[str, tuple] = {}
        self.words = np.zeros(len(order), np.int64)
        for i, n in enumerate(self.names):
            if n not in known:
                known = {n: (_bits(list(n))[0], _bits([n[j : j + 2] for j in range(len(n) - 1)])[0])}
            self.letters[i], self.pairs[i] = known[n]
            self.text[: len(n), i] = [self.codes.setdefault(c, len(self.codes) + 1) for c in n]
            own = words_of(n)
            self.words[i] = len(own)
            for w in own:
                listed[w].append(i)
        self.listed = {w: np.array(x) for w, x in listed.items()}
        self.compared = 0

    def ratios(self, name: str, at: np.ndarray) -> np.ndarray:
        """The indel ratios of name and the names at these places."""
        self.compared += len(at)
        total = len(name) + self.length[at]
        if len(name) > 64:
            lcs = np.array([lcs_length(name, self.names[i]) for i in at], np.int64)
        else:
            masks = np.zeros(len(self.codes) + 1, np.uint64)
            for i, c in enumerate(name):
                if c in self.codes:
                    masks[self.codes[c]] |= np.uint64(1 << i)
            s = np.full(len(at), np.iinfo(np.uint64).max)
            for row in self.text[: int(self.length[at].max(initial=0))]:
                u = s & masks[row[at]]
                s = (s + u) | (s - u)
            lcs = len(name) - np.bitwise_count(s & np.uint64((1 << len(name)) - 1)).astype(np.int64)
        return np.where(total > 0, 2 * lcs / np.maximum(total, 1), 1.0)

    def best(self, name: str, threshold: float, most: int, lot: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the `most` most similar names at or above the threshold, ties by key."""
        own = words_of(name)
        common = np.zeros(len(self.names), np.int64)
        for w in own:
            if w in self.listed:
                common[self.listed[w]] += 1
        shared = np.where(common > 0, common / np.maximum(np.maximum(self.words, len(own)), 1), 0.0)
        la = len(name)
        total = la + self.length
        bound = np.where(total > 0, 2.0 * np.minimum(la, self.length) / np.maximum(total, 1), 1.0)
        near = np.flatnonzero(bound >= threshold)
        if len(near):
            a, e = int(near[0]), int(near[-1]) + 1  # one stretch, as the block is sorted by length
            (letters, lost), (pairs, lost_pairs) = _bits(list(name)), _bits([name[j : j + 2] for j in range(la - 1)])
            lcs = np.bitwise_count(self.letters[a:e] & letters).sum(1, dtype=np.int64) + lost
            lcs = np.minimum(lcs, (np.bitwise_count(self.pairs[a:e] & pairs).sum(1, dtype=np.int64) + lost_pairs + total[a:e] + 1) // 3)
            bound[a:e] = np.where(total[a:e] > 0, np.minimum(bound[a:e], 2.0 * lcs / np.maximum(total[a:e], 1)), 1.0)
        upper = np.maximum(np.where(bound >= threshold, bound, 0.0), shared)
        left = np.flatnonzero(upper >= threshold)
        left = left[np.argsort(-upper[left], kind="stable")]
        found, values = np.zeros(0, np.int64), np.zeros(0)
        while len(left):
            at, left = left[:lot], left[lot:]
            value = np.maximum(self.ratios(name, at), shared[at])
            good = value >= threshold
            found, values = np.concatenate([found, at[good]]), np.concatenate([values, value[good]])
            by = sorted(range(len(found)), key=lambda i: (-values[i], self.keys[found[i]]))[:most]
            found, values = found[by], values[by]
            if len(found) == most:
                threshold = float(values[-1])
                left = left[upper[left] >= threshold]
        return found, values


def _blocks(sizes: DataFrame, side: str, block: int) -> DataFrame:
    """Places with more names than a block holds, and into how many blocks they fall: at most one row per `block` names."""
    return sizes.groupBy("place_key").count().where(F.col("count") > block).select("place_key", F.ceil(F.col("count") / block).cast("int").alias(side))


def most_similar(names: DataFrame, register: DataFrame, threshold: float = 0.6, most: int = 5, block: int = 8192) -> DataFrame:
    """names: (place_key, name); register: (place_key, name, key). (place_key, name, key, similarity, place) with the `most` most similar names
    of the same place, ties by key, for every distinct name."""
    asked = names.select("place_key", "name").distinct()
    rank = F.row_number().over(Window.partitionBy("place_key", "name").orderBy("key"))
    held = register.select("place_key", "name", "key").withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")
    grid = _blocks(asked, "rows", block).join(_blocks(held, "cols", block), "place_key", "full")

    def dealt(df: DataFrame, own: tuple[str, str], others: tuple[str, str], *key: str) -> DataFrame:
        """Each row in one block of its own side, once for each block of the other."""
        (n, mine), (m, theirs) = own, others
        rows = df.join(grid, "place_key", "left").withColumn(mine, F.pmod(F.xxhash64(*key), F.coalesce(n, F.lit(1))).cast("int"))
        return rows.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(m, F.lit(1)) - 1))).drop("rows", "cols")

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asked) and len(held):
            index = NameIndex(held["name"].tolist(), held["key"].tolist())
            place = asked["place_key"].iloc[0]
            for name in asked["name"]:
                at, values = index.best(name, threshold, most)
                out += [(place, name, k, v) for k, v in zip(index.keys[at], values.tolist())]
        return pd.DataFrame(out, columns=["place_key", "name", "key", "similarity"])

    by = ["place_key", "i", "j"]
    rows, cols = ("rows", "i"), ("cols", "j")
    met = dealt(asked, rows, cols, "name").groupBy(*by).cogroup(dealt(held, cols, rows, "name", "key").groupBy(*by)).applyInPandas(meet, "place_key string, name string, key string, similarity double")
    place = F.row_number().over(Window.partitionBy("place_key", "name").orderBy(F.desc("similarity"), "key"))
    return met.withColumn("place", place).where(F.col("place") <= most)


def asked_names(vendors: DataFrame, name: Column, city: Column) -> DataFrame:
    """(vendor_key, place_key, name) of vendors that have a city."""
    return vendors.withColumn("place_key", F.lower(city)).where("place_key <> ''").withColumn("name", name).select("vendor_key", "place_key", "name")


def cross_reference(vendors: DataFrame, register: DataFrame, name: Column, city: Column, threshold: float = 0.6, most: int = 5) -> DataFrame:
    """(vendor_key, match_key, similarity, place): most_similar() of every vendor's name, as `name` cleans it, in its city."""
    own = asked_names(vendors, name, city)
    return own.join(most_similar(own, register, threshold, most), ["place_key", "name"]).select("vendor_key", F.col("key").alias("match_key"), "similarity", "place")
