"""Quality classifier from weak labels.

Overlapping heuristic labellers look at each whole text and vote good, bad or nothing. The votes of all documents
are counted by pattern (at most 3^labellers patterns, whatever the input), and expectation-maximisation over
these counts estimates how often each labeller is right. Labellers overlap: bad documents are bad in one of several
ways, and those who look at the same thing agree on it. So the model has one class of good documents and one
kind of bad ones per labeller to begin with; within a class votes are independent. Nothing but the start and
a weak prior (`pseudo` votes) says which class is which; kinds that no document needs end without a share. The posteriors of the
patterns are the labels from which a hashed linear scorer learns; it sees words, marks and shapes, so it also judges
documents for which no labeller votes. True labels are never used.

Counts and accuracies cover all documents. The scorer learns from at most `max_train` documents, the ones whose id and text
have the smallest hash, with at most `max_features` features in all (documented bounds; rows equal in id and text count once).

Defined cases: null text counts as empty; an empty text is bad for the labellers that look at length. Null ids
are scored like others, but teach nothing. Rows that repeat an id are scored one by one. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, column, materialize, require

TERM = re.compile(r"\w+|[^\w\s]+")
# Sentence ends that prose uses.
ENDS = ".!?:;\"')]…»”"


def shape(term: str) -> str:
    if term[0].isdigit():
        return "#digits"
    if term.isalpha():
        return "#upper" if term.isupper() and len(term) > 1 else "#title" if term[0].isupper() else "#lower"
    return "#mark" + str(min(len(term), 3)) if not (term[0].isalnum() or term[0] == "_") else "#mixed"


def _kinds() -> np.ndarray:
    """Of each character below 65,536: 1 upper-case letter, 2 other letter, 3 symbol, 4 exclamation mark, 0 any other."""
    out = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            out[i] = 1 if c.isupper() else 2
        elif not (c.isalnum() or c.isspace() or c in ".,;:!?'\"()-"):
            out[i] = 3
    out[ord("!")] = 4
    return out


KINDS = _kinds()


def measures(text: str) -> dict[str, float]:
    """What the labellers look at; the shares are of words, lines or characters of the whole text
    (of a least number where a few would say little)."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(len(words), 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(KINDS[np.minimum(codes, 0xFFFF)], minlength=5)
    letters = int(kinds[1] + kinds[2])
    counts, few = Counter(lines), Counter(words)
    marked = bars = 0
    for w, k in few.items():
        if not w[-1].isalnum():
            if len(w.rstrip("#$%&*+=|~^<>!")) + 1 < len(w):
                marked += k
            if not w[0].isalnum() and not any(map(str.isalnum, w)):
                bars += k
    return {
        "words": len(words),
        "symbols": int(kinds[3]) / max(len(text), 200),
        "marked": marked / n,
        "bars": bars / max(n, 12),
        "upper": int(kinds[1]) / max(letters, 30),
        "shouts": int(kinds[4]) / n,
        "repeats": sum(k - 1 for k in counts.values()) / max(len(lines), 1),
        "again": sum(map(eq, words, words[1:])) / n,
        "top_word": max(few.values(), default=0) / max(n, 12),
        "ended": sum(x.rstrip()[-1] in ENDS for x in lines) / max(len(lines), 1),
        "mean_word": letters / n,
    }


#: (name, measure, bad below, good from, good to, bad above); a value in between gives no vote.
LABELLERS = (
    ("length", "words", 1, 30, 1e9, 1e12),
    ("symbols", "symbols", -1, 0.0, 0.004, 0.02),
    ("marks", "marked", -1, 0.0, 0.02, 0.15),
    ("tables", "bars", -1, 0.0, 0.01, 0.1),
    ("capitals", "upper", -1, 0.0, 0.08, 0.3),
    ("shouting", "shouts", -1, 0.0, 0.01, 0.1),
    ("repetition", "repeats", -1, 0.0, 0.05, 0.3),
    ("stutter", "again", -1, 0.0, 0.01, 0.1),
    ("one_word", "top_word", -1, 0.0, 0.12, 0.5),
    ("sentences", "ended", 0.2, 0.8, 1.0, 2.0),
    ("word_length", "mean_word", 1.5, 2.5, 9.0, 14.0),
)


def votes(text: str) -> str:
    """One of '+', '-', '0' per labeller."""
    m = measures(text)
    out = []
    for _, name, low, good, to, high in LABELLERS:
        x = m[name]
        out.append("-" if x < low or x > high else "+" if good <= x <= to else "0")
    return "".join(out)


def fit_votes(patterns: dict[str, int], prior: float = 0.85, rounds: int = 200, pseudo: float = 20.0) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted patterns: P(good) by pattern; P(bad vote | a vote, class) as (class, labeller),
    where class 0 is good and class k + 1 the kind of bad documents that labeller k saw first; the classes' shares.
    A labeller that gives no vote says nothing."""
    k = len(LABELLERS)
    names = sorted(patterns)
    count = np.array([patterns[p] for p in names], float)
    bad = np.array([[v == "-" for v in p] for p in names], float).reshape(len(names), k)
    given = np.array([[v != "0" for v in p] for p in names], float).reshape(len(names), k)
    start = np.full((k + 1, k), 0.1)
    start[0], start[np.arange(1, k + 1), np.arange(k)] = 0.01, 0.7
    table, share = start.copy(), np.array([prior] + [(1 - prior) / k] * k)
    post = np.full((len(names), k + 1), 1.0)
    for _ in range(rounds if names else 0):
        log = np.log(share) + bad @ np.log(table).T + (given - bad) @ np.log(1 - table).T
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        weight = post * count[:, None]
        share = (weight.sum(0) + 1) / (count.sum() + k + 1)
        table = (weight.T @ bad + pseudo * start) / (weight.T @ given + pseudo)
    return dict(zip(names, post[:, 0].tolist())), table, share


def features(text: str, hashes: WordHashes, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their values: square roots of shares of terms, marks and shapes in the whole text."""
    terms = TERM.findall(text)
    c = Counter(terms)
    both: Counter = Counter()
    for t, n in c.items():
        both[hashes[t.lower()] & mask] += n
        both[hashes[shape(t)] & mask] += n
    words = text.split()
    again = sum(map(eq, words, words[1:]))
    if again:
        both[hashes["#again"] & mask] += again
    both[hashes[f"#length{len(terms).bit_length()}"] & mask] += max(len(terms), 1)
    keys = np.fromiter(both.keys(), np.int64, len(both))
    values = np.sqrt(np.fromiter(both.values(), np.float64, len(both)) / max(len(terms), 1))
    return keys, values


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, rounds: int = 80, rate: float = 0.15, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, full batches with adaptive steps."""
    w, b = np.zeros(size), 0.0
    if not rows:
        return w, b
    n = len(rows)
    row = np.repeat(np.arange(n), [len(k) for k, _ in rows])
    key, value = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows])
    used, slot = np.unique(key, return_inverse=True)
    u, m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    u[-1] = np.log(np.clip(y.mean(), 0.01, 0.99) / np.clip(1 - y.mean(), 0.01, 0.99))
    for t in range(1, rounds + 1):
        z = u[-1] + np.bincount(row, value * u[slot], n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.append(np.bincount(slot, g[row] * value, len(used)) + decay * u[:-1], g.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        u -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    w[used], b = u[:-1], float(u[-1])
    return w, b


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, max_train: int = 10_000, max_features: int = 16_000_000, bits: int = 18) -> DataFrame:
    """(doc_id, votes, label, score, predicted) for every row: label is the labellers' posterior of good, score the
    linear scorer's, predicted 1 if score reaches the threshold."""
    require(docs, id_col, text_col)
    size = 1 << bits
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "r": b["r"], "votes": [votes(t) for t in b["text"]]})

    keyed = rows.withColumn("r", F.xxhash64("text"))
    voted = materialize(keyed.mapInPandas(vote, "doc_id long, r long, votes string"), "quality-votes")
    patterns = {x.votes: x["count"] for x in voted.groupBy("votes").count().collect()}  # at most 3^labellers
    posterior, _, _ = fit_votes(patterns)
    # a first cut by hash keeps the top-k itself small on any input
    share = min(1.0, 1.1 * max_train / max(sum(patterns.values()), 1))
    draw = F.xxhash64("doc_id", "r", F.lit(29))
    near = F.pmod(F.shiftrightunsigned(draw, 24), F.lit(1 << 30)) < int(share * (1 << 30))
    chosen = voted.where(near & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "r"]).orderBy(draw, "doc_id", "r").limit(max_train)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(seed=9)
        for b in batches:
            both = [features(t, hashes, size - 1) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "r": b["r"], "votes": b["votes"], "k": [k.astype(np.int32).tobytes() for k, _ in both], "v": [v.astype(np.float32).tobytes() for _, v in both]})

    sample = keyed.join(F.broadcast(chosen.select("doc_id", "r", "votes")), ["doc_id", "r"]).dropDuplicates(["doc_id", "r"])  # at most max_train rows
    taught = materialize(sample.mapInPandas(describe, "doc_id long, r long, votes string, k binary, v binary"), "quality-features")
    n_features = taught.agg(F.coalesce(F.sum(F.octet_length("k") / 4), F.lit(0.0))).first()[0]
    if n_features > max_features:  # long texts: fewer rows, drawn by hash
        taught = taught.where(F.pmod(F.shiftrightunsigned(draw, 24), F.lit(1 << 30)) < int(share * max_features / n_features * (1 << 30)))
    taught = taught.toPandas().sort_values(["doc_id", "r"])
    y = np.array([posterior[p] for p in taught["votes"]], float)
    w, bias = fit_linear([(np.frombuffer(k, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64)) for k, v in zip(taught["k"], taught["v"])], y, size)
    weights = {int(i): float(w[i]) for i in np.flatnonzero(w)}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(seed=9)
        dense = np.zeros(size)
        dense[list(weights)] = list(weights.values())
        for b in batches:
            given, scores = [], []
            for t in b["text"]:
                k, v = features(t, hashes, size - 1)
                scores.append(1 / (1 + np.exp(-np.clip(bias + float(dense[k] @ v), -30, 30))))
                given.append(votes(t))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "votes": given, "label": [posterior[p] for p in given], "score": scores})

    out = rows.mapInPandas(score, "doc_id long, votes string, label double, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
