import random

import numpy as np
import pytest

from quarrymill.llm.chosen_path import Forest, components, intersections, keep_one, near_duplicates, runs_for


def words(t):
    return (t or "").lower().split()


def sets(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([()])


def brute(rows):
    """{(id, text): (class id, links)} by comparing all pairs."""
    by = {}
    for i, t in rows:
        by.setdefault(sets(t), []).append(2**63 - 1 if i is None else i)
    keys = list(by)
    forest, links = Forest(len(keys)), [0] * len(keys)
    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                forest.link(a, b)
    least = {}
    for k, key in enumerate(keys):
        r = forest.root(k)
        least[r] = min(least.get(r, 2**63 - 1), *by[key])
    at = {key: (least[forest.root(k)], links[k]) for k, key in enumerate(keys)}
    return [(i, *at[sets(t)]) for i, t in rows]


def corpus(seed, groups=12, size=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.randint(40, 90))]
        for k in range(rng.randint(1, size) if g else 60):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = word()
            rows.append((n, " ".join(t)))
            n += 1
            if rng.random() < 0.3:
                rows.append((n, rows[-1][1].upper()))
                n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "one two"), (n + 3, "one  two"), (None, rows[0][1]), (5, "same id, other text it is"), (5, "same id, other text it is")]
    return rows


@pytest.mark.parametrize("seed,bucket,block", [(1, 64, 256), (2, 8, 16)])
def test_against_all_pairs(spark, seed, bucket, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = near_duplicates(df, bucket=bucket, block=block).collect()
    null = lambda x: 2**63 - 1 if x is None else x
    assert sorted((null(r.doc_id), r.class_id, r.n_links) for r in got) == sorted((null(i), c, n) for i, c, n in brute(rows))


def test_one_of_each_group_stays(spark):
    rows = corpus(3, groups=5)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = keep_one(df)
    assert kept.columns == df.columns
    got = [2**63 - 1 if r.doc_id is None else r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted({c for _, c, _ in brute(rows)})


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "a b c " * 30_000), (2, "a b c " * 30_000 + "d")], "doc_id long, text string")
    assert near_duplicates(df.limit(0)).count() == 0
    assert {r.class_id for r in near_duplicates(df).collect()} <= {1, 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and {got[100], got[101], got[102]} == {100}


def test_intersections():
    rng = np.random.default_rng(0)
    data = [np.unique(rng.integers(0, 50, n).astype(np.uint64)) for n in (1, 5, 30, 60)]
    want = [[len(np.intersect1d(a, b)) for b in data] for a in data]
    assert intersections(data, columns=7).tolist() == want


def test_no_link_of_a_large_group_is_lost(spark):
    """Variants of one text, far more than a bucket holds, each near to some of the others only."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(700):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, bucket=16, block=100).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(brute(rows))


def test_pairs_in_large_buckets_of_unlike_texts(spark):
    rng = random.Random(7)
    some = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passage, rows = some(87), []
    for k in range(600):  # two texts of a pair are alike at 0.81, others at 0.3
        pair = passage + some(78)
        rows += [(2 * k, " ".join(pair + some(19))), (2 * k + 1, " ".join(pair + some(19)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, bucket=2, pivots=1).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == [(i, i - i % 2, 1) for i in range(1200)]


def test_runs_hold_the_recall_down_to_the_last_depth():
    rng = random.Random(3)

    def lives(agree, used, branches):
        left = [i for i in range(64) if i not in used]
        return len(used) == 10 or any(agree[i] and lives(agree, [*used, i], branches) for i in rng.sample(left, branches))

    def lost(runs, branches, pairs=1000):
        out = 0
        for _ in range(pairs):
            agree = [rng.random() < 0.8 for _ in range(64)]
            starts = (rng.sample(range(64), 3) for _ in range(runs))
            out += not any(all(agree[i] for i in s) and lives(agree, s, branches) for s in starts)
        return out

    assert lost(runs_for(0.9999, 0.8, 64, 3, 10, 2), 2) <= 2
    assert lost(13, 1) > 200  # as many runs as three tokens ask for


@pytest.mark.parametrize("strays", [0, 64])
def test_members_apart_from_the_hub_of_a_bucket(spark, strays):
    """Copies with many changes each, some of them in pairs that are alike only one with the other."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(100)]
    rows = []
    for k in range(260):
        t = list(base)
        for _ in range(rng.randint(0, 3) if k % 10 else 9):
            t[rng.randrange(len(t))] = word()
        rows.append((len(rows), " ".join(t)))
        if k % 10 == 0:
            t[50] = word()
            rows.append((len(rows), " ".join(t)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), strays=strays, bucket=16).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(brute(rows))
