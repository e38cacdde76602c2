import random

import pytest

from quarrymill.operators import resolve

COLUMNS = "ord long, company_name string, website string, uei string, duns string, cage_code string"


def sequential(rows):
    """The rule, vendor by vendor: the first held key by identifier, website, name."""
    held, out = {}, {}
    for o, name, web, uei in sorted(rows):
        keys = [("uei", uei), ("web", web), ("name", name)]
        hits = [held[k] for k in keys if k[1] is not None and k in held]
        out[o] = hits[0] if hits else o
        if not hits:
            held |= {k: o for k in keys if k[1] is not None}
    return out


def run(spark, rows):
    df = spark.createDataFrame([(o, n, w and f"https://{w}.com", u, None, None) for o, n, w, u in rows], COLUMNS)
    return {r.ord: r.survivor for r in resolve.survivors(df).collect()}


def chain(length, start=0):
    """Vendors that share a name with the one before and a website with the one after, by turns."""
    return [(start + i, f"n{start + (i + 1) // 2 * 2}", f"w{start + i // 2 * 2}", None) for i in range(length)]


def rounds(monkeypatch):
    seen = []
    whole = resolve.checkpointed

    def counted(df):
        seen.append(df.columns)
        return whole(df)

    monkeypatch.setattr(resolve, "checkpointed", counted)
    return seen


def test_long_chain_in_few_rounds(spark, monkeypatch):
    rows = chain(10_000)
    seen = rounds(monkeypatch)
    assert run(spark, rows) == sequential(rows)
    # every round writes `state` once, every doubling its pointers
    assert sum("first" in c for c in seen) + sum("moved" in c for c in seen) <= 20


@pytest.mark.parametrize("seed", range(3))
def test_chains_with_branches(spark, seed):
    rng = random.Random(seed)
    rows = chain(60) + chain(41, 1000)
    for i in range(300):
        pick = lambda kind: rng.choice([None, f"{kind}{rng.randrange(80)}", f"{kind}{rng.randrange(1000, 1040)}"])
        rows.append((2000 + i, f"x{i}" if rng.random() < 0.6 else f"n{rng.randrange(80)}", pick("w"), rng.choice([None, f"U{rng.randrange(90)}"])))
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(o, *r[1:]) for o, r in zip(order, rows)]
    assert run(spark, rows) == sequential(rows)


def test_one_key_for_all(spark):
    rows = [(i, "", f"w{i // 2}", None) for i in range(200)]
    assert run(spark, rows) == sequential(rows)
    assert run(spark, []) == {}
