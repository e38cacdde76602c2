"""Similarities of names, codes and queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words without meaning in queries; hints at how specific a query is.
STOPWORDS = ["a", "an", "and", "or", "the", "for", "of", "in", "to", "with", "by", "from"]
MAKERS = ["oem", "manufacturer", "producer", "maker", "fabricator"]
TRADES = ["distributor", "wholesaler", "installer", "integrator", "consultant", "service", "maintenance"]


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, in words of bits: one machine operation per character of b."""
    if len(a) < len(b):
        a, b = b, a
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & place.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


@F.pandas_udf(DoubleType())
def indel_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 less insertions and deletions over both lengths; null if either is null."""
    return pd.Series([indel_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def token_overlap(a: Column, b: Column) -> Column:
    """Common tokens over the larger number of tokens; 0 if either has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def content_words(text: Column) -> Column:
    """Lower-case words of three letters or more that are no stopwords, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z]+\b"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def specificity(text: Column) -> Column:
    """Content words, two more for a word of makers, one more for a word of trades."""
    low = F.lower(text)
    has = lambda words: F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), 1).otherwise(0)
    return F.size(content_words(text)) + 2 * has(MAKERS) + has(TRADES)


def code_similarity(a: Column, b: Column) -> Column:
    """1.0, 0.7 or 0.4 where two lists of industry codes meet on the whole code, four digits or two."""
    cut = lambda c, n: F.transform(F.filter(c, lambda x: F.length(x) >= n), lambda x: F.left(x, F.lit(n)))
    return (
        F.when(F.arrays_overlap(a, b), 1.0).when(F.arrays_overlap(cut(a, 4), cut(b, 4)), 0.7).when(F.arrays_overlap(cut(a, 2), cut(b, 2)), 0.4).otherwise(0.0)
    )


def site_score(domain_ratio: Column, title_ratio: Column, text: Column, city: Column, state: Column) -> Column:
    """How well a search result fits a company: names, and a tenth each for its city and state."""
    low = F.lower(text)
    near = lambda c: F.when((F.coalesce(c, F.lit("")) != "") & F.contains(low, F.lower(c)), 0.1).otherwise(0.0)
    return F.greatest(domain_ratio, 0.7 * title_ratio) + near(city) + near(state)


def site_score_by_tokens(tokens: Column, is_ca: Column, position: Column, name_in_text: Column) -> Column:
    """Token overlap for 0.6, a Canadian domain 0.2, the first place 0.1 and the next two 0.05, the name in the text 0.1; 1 at most."""
    plus = lambda test, n: F.when(test, n).otherwise(0.0)
    place = F.when(position == 1, 0.1).when(position <= 3, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), 0.6 * tokens + plus(is_ca, 0.2) + place + plus(name_in_text, 0.1))
