"""Token counts by rank-synchronous merging of byte-level pairs in ragged numpy arrays.

A text is cut at the tokenizer's special strings (one token each) and then into pre-tokens. Pre-tokens that a worker hasn't
counted yet are laid end to end in one array of symbols, with the sequence of each symbol beside it. In every round each sequence
merges its pair of lowest rank, at all places from the left, and all sequences do so at once; a sequence without a pair
that merges is done and leaves. What is left of a sequence are its tokens. Sequences of more than `LONG` bytes (text without blanks)
take the same rounds over linked positions, so that a round costs what it touches and not the length of the sequence.

The merges are read once on the driver and sent with the function: their size is the vocabulary's. Nothing is shuffled.

Defined cases: null text counts as empty, an empty text has no tokens. Rows that repeat an id are counted one by one, null ids
are kept. Texts are counted whole, at any length. An empty table gives an empty result. Tokenizers that this method does not
cover (another model, a normalizer, special strings that take blanks with them) are an error on the driver.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import methodcaller, mul

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, require

# The byte-level pre-tokenizer's pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 1024
NONE = np.iinfo(np.int32).max


class Merges:
    """The merges of a vocabulary: rank and product of a pair of symbols, and the symbols of the 256 bytes."""

    def __init__(self, first: np.ndarray, pairs: np.ndarray, made: np.ndarray, specials: list[str]):
        """pairs, made: two symbols and their product, in order of rank."""
        self.first, self.made, self.specials = first.astype(np.int32), made.astype(np.int32), specials
        self.size = int(max(first.max(initial=0), pairs.max(initial=0), made.max(initial=0))) + 1
        keys = pairs[:, 0].astype(np.int64) * self.size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], -1), np.append(order, NONE).astype(np.int32)
        born = np.full(self.size, -1)
        born[made] = np.arange(len(made))
        # a product merges on later than it was made: then the lowest rank first, at all places at once, is the order of single steps
        if (np.diff(keys[order]) == 0).any() or len(np.unique(made)) < len(made) or (born[pairs].max(1, initial=-1) >= np.arange(len(made))).any():
            raise ValueError("merges out of order, or two of them with one pair or product")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where two symbols don't merge."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys[:-1], wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE).astype(np.int32)


def _byte_characters() -> list[str]:
    """The characters that stand for the bytes 0 to 255 in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(others)) for b in range(256)]


def load_merges(path: str) -> Merges:
    """The byte-level pair vocabulary of a tokenizer.json."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    known = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    plain = not any([spec.get("normalizer"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("ignore_merges"), model.get("byte_fallback")])
    added = spec.get("added_tokens", [])
    if not (known and plain) or any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError(f"{path}: only byte-level pair vocabularies without normalizer are counted")
    ids = model["vocab"]
    parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = np.array([[ids[a], ids[b]] for a, b in parts], np.int64).reshape(-1, 2)
    made = np.array([ids[a + b] for a, b in parts], np.int64)
    return Merges(np.array([ids[c] for c in _byte_characters()]), pairs, made, [x["content"] for x in added])


def _from_the_left(at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of sorted places, those that merge: where one hit follows on another (a symbol with itself), every second of the run."""
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - start) % 2 == 0]


def merge_ragged(merges: Merges, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols left of each sequence; `symbols` holds the sequences end to end."""
    left = lengths.astype(np.int64).copy()
    of = np.repeat(np.arange(len(left)), left)
    last = np.append(of[1:] != of[:-1], True)[: len(of)]
    rank = np.full(len(symbols), NONE, np.int32)
    rank[:-1] = merges.rank(symbols[:-1], symbols[1:])
    rank[last] = NONE
    while len(of):
        starts = np.append(0, np.flatnonzero(last)[:-1] + 1)
        lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(of))))
        hit = np.flatnonzero((rank == lowest) & (rank != NONE))
        at = _from_the_left(hit, np.append(False, np.diff(hit) == 1)[: len(hit)])
        symbols[at] = merges.made[rank[at]]
        left -= np.bincount(of[at], minlength=len(left))
        last[at] = last[at + 1]
        keep = (lowest != NONE) & (left[of] > 1)
        at = at[keep[at]]
        keep[at + 1] = False
        at = np.cumsum(keep)[at] - 1  # where the products are now
        symbols, of, last, rank = symbols[keep], of[keep], last[keep], rank[keep]
        changed = np.concatenate([at, at[at > 0] - 1])
        follow = changed[~last[changed]]
        rank[changed] = NONE
        rank[follow] = merges.rank(symbols[follow], symbols[follow + 1])
    return left


def merge_long(merges: Merges, symbols: np.ndarray) -> int:
    """Symbols left of one sequence, by rounds that touch only the places of its lowest rank."""
    n = len(symbols)
    symbols, after, before = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.append(merges.rank(symbols[:-1], symbols[1:]), NONE).astype(np.int32)
    waiting: dict[int, list[np.ndarray]] = defaultdict(list)
    ranks: list[int] = []

    def wait(at: np.ndarray) -> None:
        at = at[rank[at] != NONE]
        if len(at):
            at = at[np.argsort(rank[at], kind="stable")]
            for group in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1):
                r = int(rank[group[0]])
                if r not in waiting:
                    heapq.heappush(ranks, r)
                waiting[r].append(group)

    wait(np.arange(n))
    left = n
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[rank[at] == r]
        if not len(at):
            continue
        at = _from_the_left(at, np.append(False, after[at[:-1]] == at[1:]))
        gone = after[at]
        symbols[at], rank[gone], after[at] = merges.made[r], NONE, after[gone]
        inner = after[at] < n
        before[after[at][inner]] = at[inner]
        left -= len(at)
        touched = np.unique(np.concatenate([at, before[at]]))
        touched = touched[touched >= 0]
        nexts = after[touched]
        rank[touched] = np.where(nexts < n, merges.rank(symbols[touched], symbols[np.minimum(nexts, n - 1)]), NONE)
        wait(touched)
    return left


def count_pieces(merges: Merges, pieces: list[str]) -> list[int]:
    """Tokens of each pre-token."""
    data = [p.encode("utf-8", "surrogatepass") for p in pieces]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    short = np.flatnonzero(lengths <= LONG)
    out = np.zeros(len(data), np.int64)
    out[short] = merge_ragged(merges, merges.first[np.frombuffer(b"".join(data[i] for i in short), np.uint8)], lengths[short])
    for i in np.flatnonzero(lengths > LONG):
        out[i] = merge_long(merges, merges.first[np.frombuffer(data[i], np.uint8)])
    return out.tolist()


@lru_cache(1 << 16)
def _stand_in(character: str) -> str:
    """An assigned character of the kind (letter, number, other) that the tokenizer's tables give to one that newer tables may assign."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    return next((c for c in "a1" if len(cut(c + character)) == 1), "+")


def pre_tokens(pattern: regex.Pattern, text: str) -> Iterator[str] | list[str]:
    """The pre-tokens of a text; of very long ones, one at a time."""
    if not text.isascii():
        unsure = {c: _stand_in(c) for c in set(text) if unicodedata.category(c) == "Cn"}
        if unsure:
            return (text[slice(*m.span())] for m in pattern.finditer(text.translate(str.maketrans(unsure))))
    return pattern.findall(text) if len(text) < 1 << 20 else map(methodcaller("group"), pattern.finditer(text))


def text_counter(merges: Merges, lot: int = 1 << 22, bound: int = 400_000) -> Callable[[Iterator[str | None]], Iterator[int]]:
    """A function from texts to their numbers of tokens. It works through lots of about `lot` characters and forgets the pre-tokens it has counted when they are more than `bound`."""
    pattern = regex.compile(PATTERN)
    special = regex.compile("|".join(map(regex.escape, sorted(merges.specials, key=len, reverse=True)))) if merges.specials else None
    known: dict[str, int] = {}

    def resolve(held: list[tuple[int, Counter]]) -> list[int]:
        new = list(set().union(*(c for _, c in held)).difference(known))
        known.update(zip(new, count_pieces(merges, new)))
        out = [n + sum(map(mul, map(known.__getitem__, c), c.values())) for n, c in held]
        if len(known) > bound:
            known.clear()
        return out

    def run(texts: Iterator[str | None]) -> Iterator[int]:
        held: list[tuple[int, Counter]] = []
        size = 0
        for text in texts:
            text = text or ""
            parts = special.split(text) if special and special.search(text) else [text]
            found: Counter[str] = Counter()
            for p in parts:
                found.update(pre_tokens(pattern, p))
            held.append((len(parts) - 1, found))
            size += len(text)
            if size >= lot:
                yield from resolve(held)
                held, size = [], 0
        yield from resolve(held)

    return run


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row: bytes of the text as UTF-8, its tokens in the vocabulary of the tokenizer.json at
    `tokenizer`, and whether these are more than `limit`."""
    require(docs, id_col, text_col)
    merges = load_merges(tokenizer)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = text_counter(merges)
        for b in batches:
            yield pd.Series(list(count(x if isinstance(x, str) else None for x in b)), dtype="int64")

    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(column(docs, id_col).alias("doc_id"), text.alias("text"))
    out = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counted("text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
