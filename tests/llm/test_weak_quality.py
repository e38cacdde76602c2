from collections import Counter

import numpy as np

from quarrymill.llm import weak_quality
from quarrymill.llm.weak_quality import LABELLERS, fit_votes, score_quality, votes

SF = "/root/testdata/sf0.01"


def test_votes():
    prose = "This is a plain sentence about the weather in the north. " * 8
    assert "-" not in votes(prose)
    assert "-" in votes("ab### cd$$$ ef%%% " * 30) and "-" in votes("BUY NOW!! " * 40) and "-" in votes("a | b | c | d | " * 20)
    assert len(votes("")) == len(LABELLERS)


def plain_em(rows, rounds, prior=0.85, pseudo=20.0):
    """The same model, row by row and class by class."""
    k = len(LABELLERS)
    start = [[0.01] * k] + [[0.7 if j == c else 0.1 for j in range(k)] for c in range(k)]
    table, share = [list(r) for r in start], [prior] + [(1 - prior) / k] * k
    for _ in range(rounds):
        post = []
        for row in rows:
            p = []
            for c in range(k + 1):
                x = share[c]
                for j, v in enumerate(row):
                    x *= {"-": table[c][j], "+": 1 - table[c][j], "0": 1.0}[v]
                p.append(x)
            post.append([x / sum(p) for x in p])
        share = [(sum(p[c] for p in post) + 1) / (len(rows) + k + 1) for c in range(k + 1)]
        for c in range(k + 1):
            for j in range(k):
                minus = sum(p[c] for p, r in zip(post, rows) if r[j] == "-")
                both = sum(p[c] for p, r in zip(post, rows) if r[j] != "0")
                table[c][j] = (minus + pseudo * start[c][j]) / (both + pseudo)
    return {r: p[0] for r, p in zip(rows, post)}, table, share


def test_estimates_are_those_of_a_plain_em():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        wrong = set(rng.choice(len(LABELLERS), 3, replace=False)) if rng.random() < 0.2 else set()
        rows.append("".join("0" if rng.random() < 0.1 else "-" if (j in wrong) != (rng.random() < 0.02) else "+" for j in range(len(LABELLERS))))
    post, table, share = fit_votes(dict(Counter(rows)), rounds=12)
    want, table2, share2 = plain_em(rows, 12)
    assert np.allclose(table, table2) and np.allclose(share, share2) and all(abs(post[r] - want[r]) < 1e-9 for r in rows)


def test_accuracies_are_estimated():
    k = len(LABELLERS)
    good, bad = "+" * k, "--" + "+" * (k - 2)
    post, table, share = fit_votes({good: 850, bad: 100, "-" + "+" * (k - 1): 50})
    assert post[good] > 0.9 and post[bad] < 0.1 and 0.8 < share[0] < 0.95
    assert fit_votes({})[0] == {}


def test_the_sample_is_bounded_whatever_repeats(spark):
    df = spark.createDataFrame([(1, "same text of a few words.")] * 500 + [(i, f"text {i} of a few words.") for i in range(300)], "doc_id long, text string")
    seen, whole = [], weak_quality.fit_linear
    weak_quality.fit_linear = lambda rows, *more: (seen.append(len(rows)), whole(rows, *more))[1]
    try:
        assert score_quality(df, max_train=50).count() == 800
        assert score_quality(df, max_features=700).count() == 800
    finally:
        weak_quality.fit_linear = whole
    assert 0 < seen[0] <= 50 and 0 < seen[1] < 150


def test_labels_that_were_never_seen(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in score_quality(docs).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count()
    assert sum(got[i].predicted == y for i, y in truth.items()) / len(truth) > 0.97
    assert sum(got[i].predicted == 0 and y == 1 for i, y in truth.items()) <= 0.01 * len(truth)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "word " * 60_000, 3), (2, "A good line. " * 20, 4)], "doc_id long, text string, votes int")
    assert score_quality(df).count() == 4
    assert score_quality(df.limit(0)).count() == 0
