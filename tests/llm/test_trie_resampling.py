import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quarrymill.llm.trie_resampling import Trie, resample, runs, words_of

LAST = 2**63


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, n=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, n)[1]) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())  # noqa: N806
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in rows:
        words, fs = features(text, n)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words) >= least])
    pool = sorted((x for x in out if x[5]), key=lambda x: (-x[3], LAST if x[0] is None else x[0]))
    for k, x in enumerate(pool[: percent * len(pool) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def texts(rng, count):
    words = [f"w{k}" for k in range(60)] + ["Ünï", "ABC", "x9", "漢字"]
    return [" ".join(rng.choice(words[: rng.choice((8, 64))]) for _ in range(rng.randrange(60))) + rng.choice(["", ".", "\n--", "\x00é"]) for _ in range(count)]


@pytest.mark.parametrize("n,buckets,max_nodes", [(1, 10_000, 500_000), (1, 7, 20), (3, 10_000, 50), (2, 50, 500_000)])
def test_against_brute_force(spark, n, buckets, max_nodes):
    rng = random.Random(n * 100 + buckets)
    rows = list(enumerate(texts(rng, 300))) + [(None, "a b " * 20), (1000, None), (1001, ""), (1002, "!!"), (5, "again " * 30), (1003, "hot " * 40_000)]
    target = texts(rng, 20) + [None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rank int").repartition(5)
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=buckets, percent=25, max_nodes=max_nodes)
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, n, buckets, 25)


def test_ties_and_small_tables(spark):
    docs = spark.createDataFrame([(7, "same words " * 12)] * 30 + [(8, "other")], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    got = resample(docs, target, percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 16)) and len(got) == 31
    assert resample(docs.limit(0), target).collect() == []
    assert [r.rank for r in resample(docs.where("doc_id = 8"), target).collect()] == [None]


def test_states_follow_from_parents():
    trie = Trie(4)
    trie.add(words_of("Ein kleines ÜBEL kam vorbei"))
    by_crc = {node[0]: node[1] for node in trie.all()}
    assert len(by_crc) == runs(5, 4) == 14
    assert by_crc[zlib.crc32("ein kleines Übel kam".encode())] == 1
