from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm.pfair_mix import in_order, mix, period, reduced, tempered


SOURCES = st.lists(st.tuples(st.integers(1, 60), st.integers(1, 12)), min_size=1, max_size=7)


def served(blocks, weights):
    """The fluid schedule, exactly: blocks served of every source after every slot."""
    left, done, out = [Fraction(n) for n in blocks], [Fraction(0)] * len(blocks), []
    for _ in range(sum(blocks)):
        room = Fraction(1)
        while room:
            total = sum(w for n, w in zip(left, weights) if n)
            step = min([room] + [n * total / w for n, w in zip(left, weights) if n])
            for i, w in enumerate(weights):
                if left[i]:
                    done[i], left[i] = done[i] + step * w / total, left[i] - step * w / total
            room -= step
        out.append(list(done))
    return out


def whole_schedule(blocks, weights):
    """All slots by the operator's own periods."""
    out = []
    for k in range(max(-(-n // w) for n, w in zip(blocks, weights))):
        live = [i for i, (n, w) in enumerate(zip(blocks, weights)) if n > k * w]
        out += [(live[i], k * weights[live[i]] + j) for i, j in period([weights[i] for i in live], [min(weights[i], blocks[i] - k * weights[i]) for i in live])]
    return out


@settings(max_examples=60, deadline=None)
@given(SOURCES)
def test_every_source_is_less_than_a_block_from_the_fluid_schedule(x):
    blocks, weights = [n for n, _ in x], [w for _, w in x]
    order, done = whole_schedule(blocks, weights), [0] * len(x)
    for (i, b), fluid in zip(order, served(blocks, weights)):
        assert b == done[i]  # blocks of a source stay in order
        done[i] += 1
        assert all(abs(d - f) < 1 for d, f in zip(done, fluid))
    assert done == blocks


def test_reduced_weights():
    assert reduced({"a": 3_000_000, "b": 1_000_000}, 100) == {"a": 3, "b": 1}
    big = reduced({"a": 10**9, "b": 10**9 + 7, "c": 1}, 1000)
    assert sum(big.values()) <= 1003 and abs(big["a"] - big["b"]) <= 1 and big["c"] == 1


def docs(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 4}" if i % 5 else None, i) for i in range(300)] + [(None, "x", "hot", 1), (7, "t7", "hot", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


def test_all_rows_are_placed(spark):
    got = mix(docs(spark), block_rows=4, range_rows=16).collect()
    assert len(got) == 302 and len({r.mix_order for r in got}) == 302
    blocks = {}
    for r in got:
        blocks.setdefault((r.mix_source, r.mix_block), set()).add(r.mix_slot)
    assert all(len(s) == 1 for s in blocks.values()) and sorted(x for s in blocks.values() for x in s) == list(range(len(blocks)))
    assert {r.mix_source for r in got if r.source is None} == {""}
    assert sorted(map(str, mix(docs(spark), block_rows=4, range_rows=16, broadcast_blocks=0).collect())) == sorted(map(str, got))


def test_the_whole_result_is_the_schedule_by_hand(spark):
    """Numbers by the order of hashes, blocks by number, slots by one run of the scheduler over all blocks."""
    got = mix(docs(spark), block_rows=4, range_rows=16, weights={"hot": 5, "s1": 2}).collect()
    by_source = {}
    for r in got:
        by_source.setdefault(r.mix_source, []).append(r)
    names = sorted(by_source)
    blocks, weights = [-(-len(by_source[s]) // 4) for s in names], [{"hot": 5, "s1": 2}.get(s, 1) for s in names]
    # ties of equal deadlines go to the source that ends first, then by name
    order = sorted(range(len(names)), key=lambda i: (-(-blocks[i] // weights[i]), names[i]))
    names, blocks, weights = ([y[i] for i in order] for y in (names, blocks, weights))
    slot = {(names[i], b): t for t, (i, b) in enumerate(whole_schedule(blocks, weights))}
    hashed = {(r.doc_id, r.source): r.h for r in docs(spark).selectExpr("*", "xxhash64(31, doc_id, text, source, n_chars) h").collect()}
    for s, rows in by_source.items():
        h = lambda r: hashed[r.doc_id, r.source]
        rows.sort(key=lambda r: ((h(r) >> 32) % (1 << 32) * -(-len(got) // 16) >> 32, h(r), r.mix_order))
        assert [r.mix_block for r in rows] == [k // 4 for k in range(len(rows))]
        assert all(r.mix_slot == slot[s, r.mix_block] and r.mix_order // 4 == r.mix_slot for r in rows)


def test_given_weights_hold_while_all_sources_last(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(400)], "doc_id long, source string")
    got = sorted(mix(rows, {"a": 3, "b": 1}, block_rows=10).collect(), key=lambda r: r.mix_order)
    first = [r.mix_source for r in got][:260]  # until a runs out
    for n in range(10, len(first), 10):
        assert abs(first[:n].count("a") - n * 3 / 4) < 10
    with pytest.raises(ValueError):
        mix(rows, {"a": 0, "b": 1})


def test_many_sources_and_empty(spark):
    rows = spark.createDataFrame([(i, f"s{i % 40}") for i in range(200)], "doc_id long, source string")
    got = mix(rows).collect()
    assert len(got) == 200 and {r.mix_source for r in got} == {f"s{i}" for i in range(40)}
    assert mix(rows.limit(0)).count() == 0
    clash = mix(rows.selectExpr("*", "1 mix_slot", "2 _h", "3 ps", "4 _doc", "5 _range", "6 MIX_ORDER", "7 `a.b`"))
    assert clash.count() == 200 and {"mix_slot", "mix_slot_given", "_h", "ps", "_doc", "MIX_ORDER_given", "a.b"} <= set(clash.columns)
    assert in_order(rows.selectExpr("*", "1 MIX_SLOT", "2 _at", "3 `a.b`")).columns == ["doc_id", "source", "MIX_SLOT", "_at", "a.b"]


def test_files_follow_the_order(spark, tmp_path):
    d = docs(spark)
    in_order(d, chunk_rows=64).write.parquet(str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x")).selectExpr("*", "_metadata.file_name f", "_metadata.row_index i").collect()
    assert d.columns == [c for c in back[0].asDict() if c not in "fi"]
    want = [r.doc_id for r in sorted(mix(d).collect(), key=lambda r: r.mix_order)]
    assert [r.doc_id for r in sorted(back, key=lambda r: (r.f, r.i))] == want


def test_tempered_is_flatter():
    w = tempered({"a": 900, "b": 100})
    assert 1 < w["a"] / w["b"] < 9
