import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarrymill.llm.tiered_shards import Conflict, Store, plan_merges, shard


@given(st.lists(st.integers(1, 400), max_size=60), st.integers(2, 5))
def test_plans_keep_order_and_size(sizes, fanout):
    groups = plan_merges(sizes, 500, fanout, least=4)
    assert [i for g in groups for i in g] == list(range(len(sizes)))
    assert all(len(g) == 1 or sum(sizes[i] for i in g) <= 500 for g in groups)


def test_similar_sizes_merge():
    assert plan_merges([10] * 8, 40, 4, 1) == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert plan_merges([10, 10, 900, 10], 1000, 3, 1) == [[0], [1], [2], [3]]
    assert plan_merges([10] * 16, 10_000, 4, 1) == [list(range(16))]


def frame(spark, a, b):
    return spark.createDataFrame([(i, f"text {i}", None if i % 3 else i) for i in range(a, b)], "doc_id long, text string, shard long")


def test_versions_conflicts_vacuum(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError):
        store.read()
    for k in range(5):
        store.append(frame(spark, 10 * k, 10 * k + 10).coalesce(1))
    before = store.manifest()
    assert before["version"] == 5 and len(before["shards"]) == 5
    after = store.compact(target=1 << 20, fanout=4)
    assert after["version"] == 6 and len(after["shards"]) == 1
    ids = lambda v: sorted(r.doc_id for r in store.read(v).collect())
    assert ids(6) == ids(5) == list(range(50)) and ids(2) == list(range(20))
    ordered = [r.doc_id for r in sorted(store.read(6).collect(), key=lambda r: (r.shard, r.position))]
    assert ordered == list(range(50))
    with pytest.raises(Conflict):
        store._commit(before, [], None)
    assert store.compact()["version"] == 6
    assert store.vacuum() == 5 and ids(6) == list(range(50)) and store.versions() == [6]
    store.append(frame(spark, 50, 50))
    assert ids(None) == list(range(50)) and store.manifest()["version"] == 7 and len(store.manifest()["shards"]) == 1


def test_all_rows_round_trip(spark, tmp_path):
    df = frame(spark, 0, 300).repartition(9)
    got = shard(df, target=3000, fanout=2).collect()
    assert sorted((r.doc_id, r.text, r.shard_given) for r in got) == sorted((r.doc_id, r.text, r.shard) for r in df.collect())
    assert len({(r.shard, r.position) for r in got}) == 300
    assert shard(frame(spark, 0, 0)).count() == 0


def test_order_of_files_is_kept(spark, tmp_path):
    df = frame(spark, 0, 200).drop("shard").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id")
    df.write.parquet(f"{tmp_path}/in")
    got = shard(spark.read.parquet(f"{tmp_path}/in"), in_order=True, target=5000, fanout=2).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.position))] == list(range(200)) and len({r.shard for r in got}) > 1


def test_a_writer_that_died_is_no_obstacle(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), lock_seconds=1)
    rows = spark.range(100)
    store.append(rows)
    (tmp_path / "s/manifests/v0000000002.json.lock").write_text("")
    with pytest.raises(Conflict):
        Store(spark, str(tmp_path / "s"), lock_seconds=900).append(rows)
    orphans = [p.name for p in (tmp_path / "s/data").iterdir()]
    time.sleep(1.5)
    store.append(rows)
    assert store.read().count() == 200 and not list((tmp_path / "s/manifests").glob("*.lock"))
    assert len(orphans) == 2  # the attempt that failed has left its folder
    (tmp_path / "s/manifests/v9.json.x.tmp").write_text("")
    store.vacuum(keep=5, older_than=0)
    assert store.read().count() == 200 and len(list((tmp_path / "s/data").iterdir())) == 2 and not list((tmp_path / "s/manifests").glob("*.tmp"))


def test_any_names(spark, tmp_path):
    rows = spark.range(20).selectExpr("id", "id Shard", "id POSITION", "id `a.b`", "id _name")
    got = shard(rows, str(tmp_path / "s"))
    assert got.columns == ["id", "Shard_given", "POSITION_given", "a.b", "_name_given", "shard", "position"] and got.count() == 20
    assert spark.conf.get("spark.sql.unionOutputPartitioning", None) in (None, "true")


def test_readers_of_older_versions_go_on(spark, tmp_path):
    rows = spark.range(50)
    shard(rows, str(tmp_path / "s"), target=1000, fanout=2)
    old = Store(spark, str(tmp_path / "s")).read()
    shard(rows, str(tmp_path / "s"), target=1000, fanout=2)
    assert old.count() == 50 and Store(spark, str(tmp_path / "s")).read().count() == 100


def test_two_writers_at_an_expired_lock(spark, tmp_path):
    import threading

    root = str(tmp_path / "s")
    Store(spark, root).append(spark.range(10))
    writers = [Store(spark, root, lock_seconds=-1) for _ in range(4)]  # any lock counts as left by a dead writer
    base, done, lost, start = writers[0].manifest(), [], [], threading.Barrier(4)

    def commit(store, n):
        start.wait()
        try:
            store._commit(base, base["shards"] + [{"name": f"data/x{n}", "bytes": 1, "seq": 99 + n}], None)
            done.append(n)
        except Conflict:
            lost.append(n)

    threads = [threading.Thread(target=commit, args=(w, n)) for n, w in enumerate(writers)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and len(lost) == 3
    assert Store(spark, root).manifest()["shards"][-1]["name"] == f"data/x{done[0]}" and Store(spark, root).versions()[-1] == base["version"] + 1
