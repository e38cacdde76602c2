import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarrymill.llm.block_max import LAST_ID, Queries, Search, ShardWriter, build_index, frontier, impacts, rank_documents, search, terms_of


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, queries, k=10):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, words = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    out = []
    for item, text in queries:
        scores = []
        for i, tf, n in docs:
            m = 25 + 75 * n * n_docs // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if s > 0:
                scores.append((-s, LAST_ID if i is None else i))
        out += [(item, r + 1, None if i == LAST_ID else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def tables(seed, count):
    rng = random.Random(seed)
    words = [f"t{k}" for k in range(80)] + ["Ünï", "ABC", "the", "THE", "漢字"]
    text = lambda most: " ".join(rng.choice(words[: rng.choice((4, 20, 85))]) for _ in range(rng.randrange(most))) + rng.choice(["", ".", "--", "\x00é", "\t"])
    docs = [(i, text(40)) for i in range(count)] + [(None, "the t1 t2"), (None, "the t1 t2"), (4, "the t1 t2"), (4, None), (9000, ""), (9001, "!!"), (9002, "t7 the " * 30_000)]
    docs += [(8000 + i, "one group of copies t3 t5") for i in range(60)]
    return docs, [(i, text(12)) for i in range(25)] + [(None, "the t3"), (3, "t5 copies copies"), (3, None), (99, ""), (100, "nowhere")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, queries = tables(seed, 400)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rank string").repartition(3)
    q = spark.createDataFrame(queries, "item_id long, text string")
    index = build_index(d, block_rows=8, shard_blocks=4)
    assert sorted(map(tuple, search(index, q).collect()), key=str) == brute(docs, queries)
    # several chunks of queries
    assert sorted(map(tuple, search(index, q, k=3, chunk_terms=40).collect()), key=str) == brute(docs, queries, 3)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert [tuple(r)[:3] for r in rank_documents(d, q).collect()] == [(1, 1, 1)]
    assert rank_documents(d.limit(0), q).collect() == rank_documents(d, q.limit(0)).collect() == rank_documents(d, q.where("false")).collect() == []
    assert rank_documents(d.selectExpr("doc_id", "cast(null as string) AS text"), q).collect() == []


def test_frontier_holds_the_best_of_every_term():
    rng = np.random.default_rng(1)
    term, tf, n = rng.integers(0, 20, 500), rng.integers(1, 9, 500), rng.integers(1, 60, 500)
    at = frontier(term, tf, n)
    assert len(at) < 200 and (np.diff(term[at]) >= 0).all()
    for docs, words in ((500, 12_000), (10**6, 10**7), (3, 3000)):
        x = impacts(tf, n, docs, words)
        assert [x[term == t].max() for t in range(20)] == [x[at][term[at] == t].max() for t in range(20)]


def test_blocks_that_cannot_win_stay_packed():
    rng = random.Random(3)
    writer, docs = ShardWriter(10), []
    for i in range(400):  # topics in runs of documents, as sources are
        docs.append((i, " ".join(f"w{i // 20}x{rng.randrange(12)}" for _ in range(15)) + " common"))
        writer.add(i, terms_of(docs[-1][1]))
    n, words, shard_terms, _, maxima, blocks = writer.row()
    queries = Queries([([b"w7x1", b"w7x2", b"common"], [1, 2, 1])])
    df = Counter(t for _, x in docs for t in set(terms(x)))
    queries.weigh({i: df[t.decode()] for t, i in queries.terms.items()}, n)
    found = Search(queries, n, words, 5, np.zeros(1, np.int64), np.full(1, LAST_ID))
    found.shard(shard_terms, maxima, blocks)
    got = [(0, r + 1, int(x.d), int(x.score)) for r, x in enumerate(found.hits().itertuples())]
    assert sorted(got, key=str) == brute(docs, [(0, "w7x1 w7x2 w7x2 common")], 5)
    assert len(blocks) == 40 and found.unpacked <= 4


def test_lengths_beyond_64_bits():
    n = np.array([1, 2**40], np.int64)
    assert impacts(np.array([3, 3]), n, 10**8, 10**9).tolist() == [10**9 * 3 // (3000 + 8 * (25 + 75 * x * 10**8 // 10**9)) for x in n.tolist()]
