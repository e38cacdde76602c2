import collections
import math
import zlib

import numpy as np

from quarrymill.llm.gru_lm import Gru, score_documents, words_of

SF = "/root/testdata/sf0.01"


def net(seed=3, v=23, hidden=5, per=4):
    g = Gru(np.arange(v, 0, -1).astype(float), hidden, per, seed)
    rng = np.random.default_rng(seed)
    for name, w in g.p.items():
        w += rng.normal(0, 0.3, w.shape).astype(np.float32) * (1 if name not in ("cb", "wb") else 0.1)
    return g


def test_probabilities_add_up():
    g = net()
    h = np.random.default_rng(0).normal(0, 1, (3, 5)).astype(np.float32)
    total = sum(np.exp(g.log_probabilities(h, np.full(3, t))) for t in range(23))
    assert np.allclose(total, 1, atol=1e-3)


def test_score_is_the_sum_step_by_step():
    g = net()
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(1, 23, n), 0) for n in (0, 1, 7, 90, 33, 2)]
    want = []
    for d in docs:
        h, last, total = g.start(1), np.zeros(1, np.int64), 0.0
        for t in d:
            h = g.step(last, h)[0]
            last = np.array([t])
            total += float(g.log_probabilities(h, last)[0])
        want.append(total)
    assert np.allclose(g.score(docs, lanes=2, steps=4), want, rtol=1e-4)
    assert np.allclose(g.score(docs, lanes=50, steps=64), want, rtol=1e-4)


def test_gradients():
    g = net(v=9, hidden=3, per=3)
    rng = np.random.default_rng(2)
    x, y, m = rng.integers(0, 9, (4, 2)), rng.integers(0, 9, (4, 2)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    for name in g.p:
        g.p[name] = g.p[name].astype(np.float64)
    h = np.zeros((2, 3))
    grad, _, _ = g.window(x, y, m, h)
    for name, w in g.p.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        if name == "x":
            at = (int(x[0, 0]), 1)
        old = w[at]
        w[at] = old + 1e-4
        up = g.window(x, y, m, h)[2]
        w[at] = old - 1e-4
        down = g.window(x, y, m, h)[2]
        w[at] = old
        mine = grad[name][1][list(grad[name][0]).index(at[0])][at[1]] if name == "x" else grad[name][at]
        assert abs((up - down) / 2e-4 - mine) < 2e-3, name


def test_training_helps():
    g = Gru(np.array([40.0, 1, 100, 100, 100, 100]), 8, 3)
    docs = [np.array([2, 3, 4, 5] * 5 + [0]) for _ in range(400)]
    before = g.score(docs[:5]).sum()
    g.train(docs, steps=8, batch=16, rate=0.03)
    assert g.score(docs[:5]).sum() > before * 0.3


def test_a_long_text_beside_short_ones_takes_memory_by_tokens():
    import tracemalloc

    g = net()
    docs = [np.append(np.random.default_rng(0).integers(1, 23, 60_000), 0)] + [np.array([1, 2, 3, 0])] * 600
    tracemalloc.start()
    got = g.score(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and np.isfinite(got).all() and np.allclose(got[1:], got[1])


def test_large_weights_stay_finite():
    g = net()
    for w in g.p.values():
        w *= 300
    assert np.isfinite(g.score([np.array([1, 5, 9, 0]), np.array([0])])).all()


def check(rows, got):
    counts, n = collections.Counter(), 0
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            w = [*words_of(t), b"\0end"]
            counts.update(w)
            n += len(w)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_tokens, r.n_known, round(r.base_score, 6), r.train_tokens))
    for i, t in rows:
        w = [*words_of(t), b"\0end"]
        base = sum(math.log10((counts[x] + 1) / (n + len(counts) + 1)) for x in w)
        assert (len(w), sum(counts[x] > 0 for x in w), round(base, 6), n) in by[i]


def test_base_scores_and_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = score_documents(docs, known=3000, share=0.5).collect()
    assert len(got) == len(rows)
    check(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "A a\x0bB É é"), (3, "x " * 50_000), (3, "y"), (4, "\x1fz\x85")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = score_documents(df, share=1.0).collect()
    check(rows, got)
    assert score_documents(df.limit(0)).count() == 0
    only_held = df.where("doc_id is null").selectExpr("cast(9 as long) doc_id", "text")
    assert score_documents(only_held).count() == 1


def test_few_documents_reach_the_model(spark):
    rows = [(i, "one two three four " * 400) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda **k: {r.doc_id: (r.score, r.base_score) for r in score_documents(df, **k).collect()}
    got = score()
    assert sum(s for s, _ in got.values()) > 0.9 * sum(b for _, b in got.values())  # the order of words is learnt
    none = score(share=1e-9)  # no document has so small a hash
    assert all(math.isclose(none[i][0], got[i][0], rel_tol=1e-6) for i in got)


def test_words_of_equal_counts_fill_the_table(spark):
    from quarrymill.llm.gru_lm import frequent_words

    equal = spark.createDataFrame([(f"w{i:04d}", 3) for i in range(2000)] + [("top", 9)], "w string, c long")
    rows, least = frequent_words(equal, 100)
    assert rows == [(b"top", 9)] + [(f"w{i:04d}".encode(), 3) for i in range(99)] and least == 9
    rows, least = frequent_words(equal.where("c = 3"), 100)
    assert len(rows) == 100 and least > 3
    assert frequent_words(equal, 5000)[1] == 3 and len(frequent_words(equal, 5000)[0]) == 2001
    # the base scores don't depend on how many words the table holds
    docs = spark.createDataFrame([(i, " ".join(f"w{(7 * i + j) % 400}" for j in range(20))) for i in range(200)], "doc_id long, text string")
    base = lambda known: {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in score_documents(docs, known=known).collect()}
    assert base(60) == base(100_000)


def test_words_of_a_column_are_those_of_its_texts():
    import pyarrow as pa

    from quarrymill.llm.gru_lm import in_lots, words_of_column

    texts = ["", " a\x0bB  c\x1fd\x85 \t\n x\x1c\x0c\r", "É é ÀZ", " ", "word", "", "\n\n", "Zz   zz\x00"]
    for some in (pa.array(texts), pa.array(["x y", *texts]).slice(1), pa.array(texts).slice(0, 0)):
        words, edges = words_of_column(some)
        assert [words[a:z].to_pylist() for a, z in zip(edges, edges[1:])] == [words_of(t) for t in some.to_pylist()]
    # lots follow the size of texts, not that of batches: no row is lost or moved
    sizes = [3, 0, 40, 1, 1, 1, 9, 0, 0, 25, 10, 2]
    rows = pa.RecordBatch.from_pydict({"text": ["x" * n for n in sizes], "i": list(range(12))})
    for width in (1, 5, 12):
        lots = list(in_lots((rows.slice(a, width) for a in range(0, 12, width)), size=10, rows=5))
        assert [i for b in lots for i in b.column("i").to_pylist()] == list(range(12))
        assert [b.column("i").to_pylist() for b in lots] == [[0, 1, 2], [3, 4, 5, 6], [7, 8, 9], [10], [11]]
