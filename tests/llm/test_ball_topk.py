import math
import random

import numpy as np
import pytest

from quarrymill.llm.ball_topk import NONE, build_tree, products, search_tree, top_k


def brute(rows, k=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i is not None and i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0) for m, (j, c) in enumerate(good) if m != n)[:k]
            out += [(i, place + 1, None if null else j, -s) for place, (s, null, j) in enumerate(scores)]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 60, "block_rows": 3}, {"shard_rows": 25, "block_rows": 2, "chunk_blocks": 3, "fan": 4}])
def test_against_brute_force(spark, options):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(400)]
    rows += [(500, None), (520, []), (540, [1.0, None]), (560, [float("nan")] * 6), (580, [float("inf")] * 6), (None, [1.0] * 6), (40, [0.0] * 6), (40, [0.0] * 6), (600, [0.5, 0.5]), (-20, [0.1] * 6)]
    rows += [(1000 + i, [0.25] * 6) for i in range(50)]
    rows += [(7, [5.0] * 6), (7, [6.0] * 6), (60, [3.0] * 6), (60, [4.0] * 6), (None, [9.0] * 6), (2**62, [7.0] * 6), (2**62 + 1, [7.0] * 6)]  # repeated ids, no id, ids beyond doubles
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, **options).collect()), key=str)
    assert got == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (3, [0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in top_k(df).orderBy("query_id", "rank").collect()] == [(0, 20, 8192), (0, 3, 2048), (20, 0, 8192), (20, 3, 4096)]
    assert top_k(df.limit(0)).count() == 0 and top_k(df.where("vec_id = 0")).count() == 0


def test_every_row_but_the_own_is_a_candidate(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0]), (1, [5.0, 5.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (3, [])], "vec_id long, embedding array<double>")
    want = [(20, 1, 1, 40960), (20, 2, 1, 8192), (20, 3, 20, 8192), (20, 4, 3, 0)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df).collect()) == sorted(want * 2)


@pytest.mark.parametrize("size,dim", [(3e6, 8), (2e8, 4), (1.2e9, 4), (4.5e16, 1)])
def test_large_values_stay_exact(size, dim):
    ids = np.arange(300)
    x = np.floor(np.random.default_rng(0).normal(0, 1, (300, dim)).clip(-1, 1) * size).astype(np.int64)
    if dim == 1:  # products just within 64 bits
        x = x // 2**24
    best, best_id = search_tree(build_tree(ids, x), x[:5], ids[:5], 3, np.full(5, NONE))
    for q in range(5):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(x[q], x[c])), c) for c in range(300) if c != q)[:3]
        assert [(-s, c) for s, c in zip(best[q].tolist(), best_id[q].tolist())] == want


def test_scores_beyond_64_bits_are_an_error(spark):
    assert products(np.array([[2**31, 2**31]]), np.array([[2**31, -(2**31)]])).tolist() == [[0]]
    assert products(np.array([[2**62, 1]]), np.array([[1, 2**62 - 1]])).tolist() == [[2**63 - 1]]
    with pytest.raises(OverflowError):
        products(np.array([[2**40, 2**40]]), np.array([[2**40, 2**40]]))
    with pytest.raises(Exception, match="62 bits"):
        top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_nodes_are_skipped():
    rng = np.random.default_rng(1)
    x = np.floor(np.concatenate([rng.normal(c * 100, 3, (500, 8)) for c in range(8)]))
    tree = build_tree(np.arange(4000), x)
    assert len(tree["s"]) > 60 and max(e - s for s, e, left in zip(tree["s"], tree["e"], tree["l"]) if left < 0) <= 64
