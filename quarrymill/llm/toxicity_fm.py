"""Toxicity by a factorization machine over hashed terms.

Words are hashed to buckets; a document's features are the buckets that occur in its whole text. A factorization machine
with a weight and a latent vector per bucket is fitted to the buckets that are tied to the labels (likelihood ratio), by
themselves or as one of a pair: a pair counts where the share of toxic rows among those that hold both differs from what
the two shares predict when they add up. So terms that matter only together are kept, and the pairwise term
learns what additive weights miss. Pairs are looked for among the `pair_terms` buckets that occur in most rows.

Fitting uses at most `max_train` labelled rows, the ones with the smallest hash of id and text, and at most `max_features`
buckets of all of them together (documented bounds, so the driver holds a bounded number of features, however long the
texts and however often an id is repeated; rows equal in id and text count once). Scoring reads every document whole.

Defined cases: null text counts as empty; an empty text gets the score of the bias alone. An id with
several labels counts as toxic if any of them says so; null ids and null labels teach nothing. Without
labelled rows, or with labels of one kind only, every score is the share of toxic labels (0 without any).
Rows that repeat an id are scored one by one. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, column, materialize, remainder_of_id, require

WORD = re.compile(r"\w+")


class FactorizationMachine:
    """score(x) = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the buckets i that occur."""

    def __init__(self, buckets: np.ndarray, bias: float, rank: int = 6, seed: int = 5):
        self.slot = {int(b): i for i, b in enumerate(buckets)}
        self.b, self.w = bias, np.zeros(len(buckets))
        self.v = np.random.default_rng(seed).normal(0, 0.05, (len(buckets), rank))

    def raw(self, slots: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of latent vectors; starts: where each row's slots begin."""
        linear, s, sq = np.zeros(n), np.zeros((n, self.v.shape[1])), np.zeros(n)
        if len(slots):
            row = np.repeat(np.arange(n), np.diff(np.append(starts, len(slots))))
            v = self.v[slots]
            linear = np.bincount(row, self.w[slots], n)
            s = np.stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])], 1)
            sq = np.bincount(row, (v * v).sum(1), n)
        return self.b + linear + 0.5 * ((s * s).sum(1) - sq), s

    def fit(self, slots: np.ndarray, starts: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 0.05, decay: float = 2e-4, part: int = 1024) -> None:
        """Whole batches with adaptive steps; gradients are added up over parts of the rows, which bounds their memory."""
        n, rank = len(y), self.v.shape[1]
        ends = np.append(starts, len(slots))
        m = [np.zeros(1), np.zeros_like(self.w), np.zeros_like(self.v)]
        u = [np.zeros(1), np.zeros_like(self.w), np.zeros_like(self.v)]
        for t in range(1, rounds + 1):
            gb, gw, gv = 0.0, decay * self.w, decay * self.v
            for a in range(0, n, part):
                b = min(a + part, n)
                own = slots[ends[a] : ends[b]]
                z, s = self.raw(own, starts[a:b] - ends[a], b - a)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]) / n
                row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                gr = g[row]
                gb += float(g.sum())
                gw += np.bincount(own, gr, len(self.w))
                for f in range(rank):
                    gv[:, f] += np.bincount(own, gr * (s[row, f] - self.v[own, f]), len(self.w))
            for i, grad in enumerate((np.array([gb]), gw, gv)):
                m[i] = 0.9 * m[i] + 0.1 * grad
                u[i] = 0.999 * u[i] + 0.001 * grad * grad
                step = rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(u[i] / (1 - 0.999**t)) + 1e-8)
                if i == 0:
                    self.b -= float(step[0])
                elif i == 1:
                    self.w -= step
                else:
                    self.v -= step


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows) if len(rows) and sizes.sum() else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(rows) else np.zeros(0, np.int64)


def _tied(both: np.ndarray, toxic: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Likelihood ratio of `toxic` out of `both` rows against a share."""
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda o, e: np.where(o > 0, o * np.log(o / e), 0.0)
        return 2 * (part(toxic, both * share) + part(both - toxic, both * (1 - share)))


def paired(rows: list[np.ndarray], place: np.ndarray, y: np.ndarray, a: np.ndarray, df: np.ndarray, least: float, apart: float = 0.2, chunk: int = 1024) -> np.ndarray:
    """Which of the buckets numbered by place (-1: others) take part in a pair whose toxic share differs, by `apart` and beyond chance, from what
    their own shares add up to. a, df: toxic rows and rows by number."""
    k = len(df)
    both, toxic = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    for at in range(0, len(rows), chunk):
        part = [x[x >= 0] for x in (place[r] for r in rows[at : at + chunk])]
        m = np.zeros((len(part), k), np.float32)
        m[np.repeat(np.arange(len(part)), list(map(len, part))), np.concatenate(part) if part else []] = 1
        both += m.T @ m
        m = m[y[at : at + chunk] > 0]
        toxic += m.T @ m
    logit = lambda p: np.log(p / (1 - p))
    own, base = logit((a + 0.5) / (df + 1)), logit((y.sum() + 0.5) / (len(y) + 1))
    out = np.zeros(k, bool)
    for i in range(k):  # a row of pairs at a time
        share = 1 / (1 + np.exp(-np.clip(own[i] + own - base, -30, 30)))
        tie = _tied(both[i].astype(np.float64), toxic[i].astype(np.float64), np.clip(share, 1e-6, 1 - 1e-6))
        tie[i] = 0
        found = (tie >= least) & (both[i] >= 3)
        out |= found & (np.abs(toxic[i] / np.maximum(both[i], 1) - share) >= apart)
    return out


def fit_machine(rows: list[np.ndarray], y: np.ndarray, buckets: int, keep: int, least: float, pair_terms: int = 2048, least_pair: float = 40.0) -> FactorizationMachine:
    """Chooses at most `keep` buckets by likelihood ratio (at least `least`), and those of pairs, and fits the machine to them."""
    share = float(y.mean()) if len(y) else 0.0
    bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if not len(y) or share in (0.0, 1.0):
        return FactorizationMachine(np.zeros(0, np.int64), bias)
    a, df = np.zeros(buckets), np.zeros(buckets)
    for r, t in zip(rows, y):  # a row's buckets are distinct
        df[r] += 1
        a[r] += t
    n1, n = float(y.sum()), float(len(y))
    g2 = _tied(df, a, share) + _tied(n - df, n1 - a, share)
    g2[df < 3] = 0
    chosen = np.argsort(-g2, kind="stable")[:keep]
    chosen = chosen[g2[chosen] >= least]
    common = np.argsort(-df, kind="stable")[:pair_terms]
    common = np.sort(common[(df[common] >= 3) & (df[common] < n)])
    if len(common):
        place = np.full(buckets, -1, np.int32)
        place[common] = np.arange(len(common))
        chosen = np.union1d(chosen, common[paired(rows, place, y, a[common], df[common], least_pair)])
    chosen = np.unique(chosen)
    machine = FactorizationMachine(chosen, bias)
    if len(chosen):
        slot = np.full(buckets, -1, np.int32)
        slot[chosen] = np.arange(len(chosen))
        slots, starts = _flat([s[s >= 0] for s in (slot[r] for r in rows)])
        machine.fit(slots, starts, y)
    return machine


def teach(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    held_out_mod: int = 4, held_out: int = 2, max_train: int = 20_000, max_features: int = 32_000_000, bits: int = 18, keep: int = 4096, least: float = 12.0,
) -> tuple[FactorizationMachine, int]:
    """The machine fitted to the labelled rows that are not held out, and its number of hash bits."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    buckets = 1 << bits
    truth = labels.select(column(labels, id_col).cast("long").alias("id"), column(labels, label_col).cast("int").alias("y")).where("id is not null and y is not null")
    truth = truth.where(remainder_of_id(F.col("id"), held_out_mod) != held_out).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    # ids and labels only: bounded, so it may be broadcast; a first cut by hash keeps the top-k itself small on any input
    share = min(1.0, 1.1 * max_train / max(truth.count(), 1))
    near = F.pmod(F.shiftrightunsigned(F.xxhash64("id"), 24), F.lit(1 << 30)) < int(share * (1 << 30))
    chosen = truth.where(near).orderBy(F.xxhash64("id"), "id").limit(max_train)
    sample = texts.withColumn("r", F.xxhash64("text")).join(F.broadcast(chosen), "id")

    def occur(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(seed=3)
        for b in batches:
            sets = []
            for t in b["text"]:
                words = list(set(WORD.findall(t.lower()))) if isinstance(t, str) else []
                sets.append(np.unique(hashes.of(words) & np.uint64(buckets - 1)).astype(np.int32).tobytes())
            yield pd.DataFrame({"id": b["id"], "r": b["r"], "y": b["y"], "f": sets})

    found = materialize(sample.mapInPandas(occur, "id long, r long, y int, f binary").dropDuplicates(["id", "r"]), "toxicity-features")
    # an id may have many rows, and a row many features: cut by hash, so that what is left is a sample of the whole
    n_rows, n_features = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("f") / 4), F.lit(0.0))).first()
    share = min(1.0, max_train / max(n_rows, 1), max_features / max(n_features, 1))
    if share < 1:
        found = found.where(F.pmod(F.shiftrightunsigned(F.xxhash64("id", "r"), 24), F.lit(1 << 30)) < int(share * (1 << 30)))
        found = found.orderBy(F.xxhash64("id", "r"), "id", "r").limit(max_train)
    taught = found.toPandas().sort_values(["id", "r"])
    rows, y = [np.frombuffer(f, np.int32) for f in taught.pop("f")], taught["y"].to_numpy(np.float64)
    return fit_machine(rows, y, buckets, keep, least), bits


def scorer(machine: FactorizationMachine, bits: int):
    """A pandas function from texts to scores."""
    mask = (1 << bits) - 1

    class Slots(WordHashes):
        def __missing__(self, word: str) -> int:
            s = self[word] = machine.slot.get(super().__missing__(word) & mask, -1)
            return s

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots = Slots(seed=3)
        for texts in batches:
            rows = []
            for t in texts:
                found = set(map(slots.__getitem__, set(WORD.findall(t.lower())))) if isinstance(t, str) else set()
                found.discard(-1)
                rows.append(np.fromiter(sorted(found), np.int64, len(found)))
            z, _ = machine.raw(*_flat(rows), len(rows))
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, held_out_mod: int = 4, held_out: int = 2, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    score = scorer(*teach(docs, labels, id_col, text_col, held_out_mod=held_out_mod, held_out=held_out, **options))
    ids = column(docs, id_col).cast("long")
    out = docs.select(ids.alias("doc_id"), (remainder_of_id(ids, held_out_mod) == held_out).alias("held_out"), score(column(docs, text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """docs without the rows that score at least the threshold; columns as they were, and nothing is shuffled."""
    score = scorer(*teach(docs, labels, id_col, text_col, **options))
    return docs.where(score(column(docs, text_col).cast("string")) < threshold)
