import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import ingest, writeback
from quarrymill.sources import feeds
from quarrymill.sources.store import Conflict, Store, append_new, bucket_of, replace_rows
from quarrymill.streaming import flows


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string")


def content(store, name="t", version=None):
    return {r.k: r.v for r in store.read(name, version).collect()}


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, str(tmp_path / "store"))
    out.transact(lambda c: c.put("t", rows(spark, [(i, f"a{i}") for i in range(100)]), ["k"], 16))
    return out


def test_upsert_rewrites_the_buckets_it_touches(spark, store):
    before = store.manifest()["tables"]["t"]["files"]
    delta = rows(spark, [(3, "new"), (1000, "more"), (1000, "twice")])
    touched = {str(r[0]) for r in delta.select(bucket_of(["k"], 16)).collect()}
    store.transact(lambda c: c.upsert("t", delta, ["k"], replace_rows(["k"])))
    after = store.manifest()["tables"]["t"]["files"]
    assert {b for b in after if after[b] != before.get(b)} == touched and len(touched) <= 2
    assert content(store) == {i: f"a{i}" for i in range(100)} | {3: "new", 1000: content(store)[1000]}
    assert store.read("t").count() == 102
    assert content(store, version=0)[3] == "a3"
    # nothing new: no version
    store.transact(lambda c: c.upsert("t", rows(spark, []), ["k"], replace_rows(["k"])))
    assert store.version() == 1


def test_update_sets_columns_of_rows_that_are_there(spark, store):
    store.transact(lambda c: c.update("t", rows(spark, [(5, None), (7, "x"), (555, "y")]), ["k"]))
    assert content(store) == {i: f"a{i}" for i in range(100)} | {5: None, 7: "x"}


def test_two_writers(spark, store):
    first, second = store.begin(), store.begin()
    first.upsert("t", rows(spark, [(1, "first")]), ["k"], replace_rows(["k"]))
    second.upsert("t", rows(spark, [(2, "second")]), ["k"], replace_rows(["k"]))
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert content(store)[1] == "first" and content(store)[2] == "a2"
    failed = []

    def add(n):
        try:
            store.transact(lambda c: c.upsert("t", rows(spark, [(2000 + n, "w")]), ["k"], append_new(["k"])))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=add, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and {2000, 2001, 2002, 2003} <= set(content(store)) and store.version() == 5


def test_readers_beside_a_writer(spark, store):
    stop, seen, failed = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                values = {r.v for r in store.read("t").where("k < 100").collect()}
                seen.append(len(values))
                # a version is seen whole: all rows of a round carry its number
                assert len({v.split(":")[0] for v in values if ":" in v}) <= 1
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(6):
        store.transact(lambda c, n=n: c.put("t", rows(spark, [(i, f"{n}:{i}") for i in range(100)]), ["k"], 16))
        store.vacuum(3600)
    stop.set()
    reader.join()
    assert not failed and seen and set(seen) == {100}


def test_dead_writer_and_vacuum(spark, store):
    dead = store.begin()
    dead.upsert("t", rows(spark, [(1, "lost")]), ["k"], replace_rows(["k"]))  # never committed
    store.transact(lambda c: c.upsert("t", rows(spark, [(1, "kept")]), ["k"], replace_rows(["k"])))
    assert content(store)[1] == "kept" and store.versions() == [0, 1]
    assert store.vacuum(3600) == 0 and content(store, version=0)[1] == "a1"
    time.sleep(1.1)
    assert store.vacuum(1.0) == 2  # the dead writer's bucket and the one that was replaced
    assert store.versions() == [1] and content(store)[1] == "kept" and len(content(store)) == 100
    with pytest.raises(ValueError):
        store.transact(lambda c: c.upsert("t", rows(spark, [(1, "x")]), ["k"], lambda s, d: d.select(F.col("k") + 1, "v").toDF("k", "v").unionByName(rows(spark, [(i, "") for i in range(50)]))))
    assert content(store)[1] == "kept"


def test_stream_touches_few_buckets_and_replays_nothing(spark, tmp_path):
    cols = [*feeds.CONTRACTS]
    feed = lambda ids: spark.createDataFrame([(i, *[{"legal_name": f"V{k}", "value": "2", "date": "2024-01-01"}.get(c) for c in cols]) for i, k in enumerate(ids)], "ord long, " + ", ".join(f"{c} string" for c in cols))
    store = Store(spark, str(tmp_path / "root"))
    go = lambda n: flows.ingest_stream(flows.read_stream(spark, str(tmp_path / f"in{n}"), feed([1]).schema), "canada_contracts", str(tmp_path / "root"), str(tmp_path / f"cp{n}"), buckets=32).awaitTermination()
    feed([*range(200)]).coalesce(1).write.parquet(str(tmp_path / "in0"))
    feed([5, 5, 1000]).coalesce(1).write.parquet(str(tmp_path / "in1"))
    go(0)
    before = store.manifest()["tables"]["vendors"]["files"]
    go(1)
    after = store.manifest()["tables"]["vendors"]["files"]
    assert sum(after[b] != before.get(b) for b in after) <= 2
    got = {r.legal_name: (r.total_contract_value, r.contract_count) for r in store.read("vendors").collect()}
    assert got["V5"] == (6.0, 3) and got["V1000"] == (2.0, 1) and got["V7"] == (2.0, 1) and len(got) == 201
    os.rename(tmp_path / "cp0", tmp_path / "gone")  # the first stream again, without its checkpoint
    go(0)
    assert store.version() == 1 and store.manifest()["tables"]["vendors"]["files"] == after
    whole = ingest.contract_rollup(ingest.contract_rows(feed([*range(200)])))
    assert whole.count() == 200


class Killed(Exception):
    pass


def test_codes_are_written_back_and_resumed(spark, tmp_path):
    vendors = spark.createDataFrame([(f"v{i}", f"Northern Paving {i % 9}", "Ottawa" if i % 4 else None, "canada_contracts" if i % 5 else "other") for i in range(60)], "vendor_key string, legal_name string, city string, source string")
    codes = spark.createDataFrame([("v1", "237", True), ("v2", "111", True)], "vendor_key string, code string, is_primary boolean")
    registry = spark.createDataFrame([(f"r{i}", f"Northern Paving {i}", "OTTAWA") for i in range(9)] + [("r99", "Zqx", "Ottawa")], "vendor_key string, legal_name string, city string")
    registry_codes = spark.createDataFrame([(f"r{i}", "237" if i % 2 else "238") for i in range(9)] + [("r99", "999")], "vendor_key string, code string")
    whole = writeback.prepare(vendors, codes, str(tmp_path / "a"), buckets=8)
    done = writeback.write_back_codes(whole, registry, registry_codes, ranges=4)
    broken = writeback.prepare(vendors, codes, str(tmp_path / "b"), buckets=8)
    transact, calls = broken.transact, []

    def dies(work):
        calls.append(1)
        if len(calls) == 3:
            raise Killed
        return transact(work)

    broken.transact = dies
    with pytest.raises(Killed):
        writeback.write_back_codes(broken, registry, registry_codes, ranges=4)
    assert writeback.pending(broken, 4) == [2, 3]
    again = Store(spark, str(tmp_path / "b"))
    assert writeback.write_back_codes(again, registry, registry_codes, ranges=4)["ranges"] == 2
    assert writeback.write_back_codes(again, registry, registry_codes, ranges=4)["ranges"] == 0
    for name in ("vendors", "vendor_codes"):
        assert sorted(map(str, whole.read(name).collect())) == sorted(map(str, again.read(name).collect()))
    flagged = {r.vendor_key for r in whole.read("vendors").where("naics_enriched").collect()}
    assert flagged == {f"v{i}" for i in range(60) if i % 4 and i % 5} and done["vendors"] == len(flagged)
    pairs = [(r.vendor_key, r.code) for r in whole.read("vendor_codes").collect()]
    assert len(pairs) == len(set(pairs)) == 2 * len(flagged) + 1  # 237 of v1 is stored already, 111 of v2 stays
    with pytest.raises(ValueError):
        writeback.pending(again, 5)


def test_written_back_codes_are_not_shuffled(spark, tmp_path):
    """Vendors of one name share its codes: what is dealt to tasks grows with vendors and names, not with the rows that are written."""
    vendors = spark.range(600).select(F.concat(F.lit("v"), "id").alias("vendor_key"), F.concat(F.lit("Maple Works "), F.col("id") % 3).alias("legal_name"), F.lit("Ottawa").alias("city"), F.lit("canada_contracts").alias("source"))
    registry = spark.range(3).select(F.concat(F.lit("r"), "id").alias("vendor_key"), F.concat(F.lit("Maple Works "), "id").alias("legal_name"), F.lit("OTTAWA").alias("city"))
    codes = spark.range(150).select(F.concat(F.lit("r"), F.col("id") % 3).alias("vendor_key"), F.concat(F.lit("5"), "id").alias("code"))
    none = spark.createDataFrame([("v1", "51", True), ("v2", "x", True)], "vendor_key string, code string, is_primary boolean")
    store = writeback.prepare(vendors, none, str(tmp_path / "s"), buckets=4)
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    dealt = lambda: {(s := all_.apply(i)).stageId(): s.shuffleWriteRecords() for all_ in [stages()] for i in range(all_.size())}
    before = set(dealt())
    assert writeback.write_back_codes(store, registry, codes, ranges=2) == {"ranges": 2, "vendors": 600, "codes": 600 * 150 - 1}
    assert sum(n for stage, n in dealt().items() if stage not in before) < 20_000
    pairs = [(r.vendor_key, r.code) for r in store.read("vendor_codes").collect()]
    assert len(pairs) == len(set(pairs)) == 600 * 150 + 1
    assert store.vacuum(0) >= 1 and store.read("vendor_codes").count() == len(pairs)


def test_chunks_and_rollups_of_a_store_deal_no_whole_rows(spark):
    """Rows of unseen chunks are not shuffled to meet a short list of chunks, and a roll-up without history ranks none."""
    rows = spark.range(4000).select(F.col("id").alias("ord"), F.concat(F.lit("v"), F.col("id") % 5).alias("legal_name"), *[F.lit(None).cast("string").alias(c) for c in ("standardized_name", "address", "city", "state", "employee_count_range", "gsin", "unspsc", "contact_name", "contact_email", "contact_phone", "description", "category", "postal_code")], F.col("id").cast("string").alias("contract_number"), F.lit("2").alias("value"), F.lit("2024-01-02").alias("date"))
    new, digests = ingest.unseen(ingest.chunks(rows, 100), spark.createDataFrame([], "source string, digest string"), "f")
    out = ingest.contract_rollup(ingest.contract_rows(new.drop("chunk")), history=False)
    assert "contract_history" not in out.columns
    whole = ingest.contract_rollup(ingest.contract_rows(rows)).drop("contract_history")
    assert sorted(map(str, out.select(*whole.columns).collect())) == sorted(map(str, whole.where("external_id is not null").collect())) and out.count() == 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
