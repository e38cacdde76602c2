import zlib

import numpy as np
import pytest

from quarrymill.llm.toxicity_fm import FactorizationMachine, _flat, drop_toxic, score_toxicity

SF = "/root/testdata/sf0.01"


def test_pairs_are_learned_that_no_weight_can():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([*([0] if a else []), *([1] if b else []), 2 + rng.integers(0, 3)], np.int64))
        y.append(float(a and b) if rng.random() < 1 else 0.0)
    y = np.array(y) * 1.0
    # with both or with none of the two terms the label is 1: additive weights can't say so
    y = np.array([1.0 if (0 in r) == (1 in r) else 0.0 for r in rows])
    m = FactorizationMachine(np.arange(5), 0.0)
    m.fit(*_flat(rows), y, rounds=600)
    z, _ = m.raw(*_flat(rows), len(rows))
    assert ((z > 0) == (y == 1)).mean() > 0.99


def test_raw_is_the_sum_over_pairs():
    m = FactorizationMachine(np.arange(4), 0.3)
    m.w[:] = [1, 2, 3, 4]
    z, _ = m.raw(*_flat([np.array([0, 2, 3]), np.zeros(0, np.int64)]), 2)
    pairs = sum(m.v[i] @ m.v[j] for i, j in ((0, 2), (0, 3), (2, 3)))
    assert np.allclose(z, [0.3 + 8 + pairs, 0.3])


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(got[i].predicted, y) for i, y in truth.items() if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.93
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (3, "word " * 50_000, "x"), (3, "bad", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert score_toxicity(docs, labels).count() == 4
    none = score_toxicity(docs, labels.limit(0)).collect()
    assert all(r.score < 1e-6 and r.predicted == 0 for r in none)
    assert score_toxicity(docs.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        score_toxicity(docs.drop("text"), labels)


def test_words_that_matter_only_together(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1600):
        a, b = rng.integers(0, 2, 2)
        words = [f"w{k}" for k in rng.integers(0, 60, 12)] + ["grue"] * int(a) + ["blarg"] * int(b)
        rows.append((i, " ".join(rng.permutation(words)), int(a == b)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    held = [(got[i].score > 0.5) == (y == 1) for i, _, y in rows if got[i].held_out]
    assert len(held) > 300 and sum(held) / len(held) > 0.97


def test_the_sample_is_bounded_whatever_repeats(spark):
    rows = [(1, f"bad word {k}") for k in range(300)] + [(4, "good")] * 300 + [(8, "x " + " ".join(f"v{k}" for k in range(3000)))]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (4, 0), (8, 0), (11, 1)], "doc_id long, toxic int")
    seen = []
    from quarrymill.llm import toxicity_fm

    whole = toxicity_fm.fit_machine
    toxicity_fm.fit_machine = lambda rows, y, *more: (seen.append((len(rows), sum(map(len, rows)))), whole(rows, y, *more))[1]
    try:
        assert score_toxicity(docs, labels, held_out_mod=1, held_out=1).count() == 601
        score_toxicity(docs, labels, held_out_mod=1, held_out=1, max_train=50)
        score_toxicity(docs, labels, held_out_mod=1, held_out=1, max_features=200)
    finally:
        toxicity_fm.fit_machine = whole
    assert seen[0][0] == 302 and seen[1][0] <= 50 and seen[2][1] <= 200 + 3001
