import random

import pytest

from quarrymill.functions.similarity import indel_ratio
from quarrymill.operators.similar_names import NameIndex, most_similar, words_of

FIRST = ["NORTHERN", "ATLANTIC", "PRAIRIE", "MAPLE", "PACIFIC", "GRANITE", "HARBOUR", "SUMMIT", "RIVERSIDE", "ÉTOILE", "CEDAR", "BLUE WATER", "KINGSTON", "ORION", "VERTEX"]
SECOND = ["PLUMBING", "ELECTRIC", "CONSTRUCTION", "CONSULTING", "SYSTEMS", "MARINE", "FOODS", "LOGISTICS", "SÉCURITÉ", "OFFICE SUPPLY", "AVIATION", "PAVING", "ROOFING", "DATA"]


def names(rng, count):
    out = [f"{rng.choice(FIRST)} {rng.choice(SECOND)}" + rng.choice(["", " SERVICES", " OF CANADA", f" {rng.randrange(99)}"]) for _ in range(count)]
    return ["".join(c for c in n if rng.random() > 0.03) for n in out]


def similarity(a, b):
    wa, wb = words_of(a), words_of(b)
    return max(indel_ratio(a, b), len(set(wa) & set(wb)) / max(len(wa), len(wb)) if wa and wb else 0.0)


def brute(asked, held, threshold, most):
    out = []
    for place, a in sorted(set(asked)):
        found = sorted((-similarity(a, b), k) for p, b, k in held if p == place and similarity(a, b) >= threshold)
        out += [(place, a, k, -s, i + 1) for i, (s, k) in enumerate(found[:most])]
    return out


@pytest.mark.parametrize("threshold,block", [(0.6, 8192), (0.6, 16), (0.8, 16), (0.3, 50)])
def test_against_all_pairs(spark, threshold, block):
    rng = random.Random(block)
    odd = ["", "A", "AB", "X" * 90, "X" * 64 + " Y", " ", "PLUMBING NORTHERN"]
    asked = [("a", n) for n in names(rng, 120) + odd] + [("b", n) for n in names(rng, 20)] + [("a", "NORTHERN PLUMBING")] * 50 + [("c", "ALONE")]
    held = [("a", n, f"k{i}") for i, n in enumerate(names(rng, 150) + odd)] + [("b", n, f"m{i}") for i, n in enumerate(names(rng, 20))] + [("a", "NORTHERN PLUMBING", f"z{i}") for i in range(40)]
    got = most_similar(spark.createDataFrame(asked, "place_key string, name string"), spark.createDataFrame(held, "place_key string, name string, key string"), threshold, 5, block)
    assert sorted(map(tuple, got.select("place_key", "name", "key", "similarity", "place").collect())) == sorted(brute(asked, held, threshold, 5))


def test_few_pairs_are_compared():
    rng = random.Random(9)
    held, asked = names(rng, 3000), names(rng, 200)
    index = NameIndex(held, [str(i) for i in range(len(held))])
    for n in asked:
        index.best(n, 0.6, 5)
    assert index.compared < 0.12 * len(held) * len(asked)
    index = NameIndex(held, [str(i) for i in range(len(held))])
    # names of other letters are cut by the bounds alone
    for n in ("QWJZ VXKQ", "1234567890 777", "ΑΒΓΔ ΕΖΗΘ"):
        assert len(index.best(n, 0.6, 5)[0]) == 0
    assert index.compared == 0


def test_empty(spark):
    asked, held = spark.createDataFrame([("a", "X")], "place_key string, name string"), spark.createDataFrame([("a", "X", "k")], "place_key string, name string, key string")
    assert most_similar(asked, held.limit(0)).collect() == most_similar(asked.limit(0), held).collect() == []
    assert len(most_similar(asked, held).collect()) == 1
