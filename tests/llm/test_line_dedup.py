import hashlib
import random

import pytest

from quarrymill.llm.line_dedup import BLANK, LOWER, UPPER, apply_bitmaps, keep_bitmaps

LAST = 2**63 - 1


def brute(rows):
    key = lambda x: x.strip(BLANK).translate(str.maketrans(UPPER, LOWER))
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), LAST + 1), LAST if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (LAST if i is None else i)]
        out.append((LAST if i is None else i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


def run(df):
    got = apply_bitmaps(df, keep_bitmaps(df)).collect()
    return sorted((LAST if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"common line number {k}" for k in range(6)] + ["short", "", "  Common LINE number 0\t", "Ünïcode line hére", "\x0bpadded line here\x0c"]
    rows = [(i if rng.random() > 0.05 else None, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {j}" for j in range(rng.randint(1, 12)))) for i in range(200)]
    rows += [(3, None), (4, ""), (5, "common line number 1"), (5, "common line number 1"), (5, "other text of 5"), (0, "the hot line is here")] + [(1000 + i, "the hot line is here\nthe hot line is here") for i in range(400)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, d string").repartition(5)
    assert run(df) == brute(rows)


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "a long enough line\n" * 20_000), (2, "a long enough line")], "doc_id long, text string")
    assert run(df) == brute([(1, "a long enough line\n" * 20_000), (2, "a long enough line")])
    assert run(df.limit(0)) == []
