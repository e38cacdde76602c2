import time

import pytest
from pyspark.sql import functions as F

from quarrymill import fixtures as X
from quarrymill.operators.filtering import FilterConfig, Tender
from quarrymill.plans import batches, rerun
from quarrymill.sources.store import Store

SF = "/root/testdata/sf0.001"
TENDER = Tender(city="Boston", state="Massachusetts", country="United States", set_aside="SBA", value=1_000_000.0)


def rows(store, config):
    return sorted(map(str, rerun.shortlist(store, config).select("ord", "total", "geo_tier", "capability_match_score", "rationale", "match_status", "place").collect()))


@pytest.mark.parametrize("overrides", [{"state": "Ontario", "country": "Canada", "city": "Ottawa"}, {"set_aside": None}, {"value": 50_000.0}, {"naics": ("238220",), "project_type": "roads"}, {"state": None}])
def test_rerun_equals_a_full_run(spark, tmp_path, overrides):
    from dataclasses import asdict

    vendors = X.vendors(spark, SF)
    config = FilterConfig(duplicates=False, sort_by_distance="state" not in overrides, max_candidates=40)
    store, full = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    start = rerun.first_run(store, vendors, TENDER, config)
    assert start["judged"] == start["vendors"] == vendors.count()
    done = rerun.rerun(store, overrides, config)
    rerun.first_run(full, vendors, Tender(**(asdict(TENDER) | overrides)), config)
    assert rows(store, config) == rows(full, config)
    if "naics" in overrides:
        assert done["judged"] == 0 and done["scored"] == len(rows(store, config))
    else:
        assert 0 < done["judged"] and done["scored"] < 40
    # back again: the scores are there
    back = rerun.rerun(store, {k: getattr(TENDER, k) for k in overrides}, config)
    assert back["judged"] == done["judged"] and ("naics" in overrides or back["scored"] == 0)
    assert rerun.rerun(store, {}, config)["judged"] == 0


def test_a_small_override_moves_few(spark, tmp_path):
    vendors = X.vendors(spark, SF)
    config = FilterConfig(duplicates=False, sort_by_distance=True, max_candidates=None)
    store = Store(spark, str(tmp_path / "s"))
    rerun.first_run(store, vendors, TENDER, config)
    done = rerun.rerun(store, {"state": "Rhode Island"}, config)
    states = {r.state for r in vendors.join(store.read("judged", 0).select("ord", F.col("geo_tier").alias("t0"), F.col("geo_score").alias("g0")), "ord").join(store.read("judged").select("ord", F.col("geo_tier").alias("t1"), F.col("geo_score").alias("g1")), "ord").where("t0 <> t1 or g0 <> g1").select("state").collect()}
    assert done["scored"] == 0 and done["judged"] == vendors.where(F.col("state").isin(list(states))).count() < done["vendors"] / 2


def gate_inputs(spark, n, ready, score):
    vendors = spark.range(n).select(F.col("id").alias("place"), F.lit("x").alias("company_name"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("phone"), F.lit("w").alias("website"), F.lit(None).cast("string").alias("scrape_error"))
    enrich = lambda df: df.withColumn("website_content", F.when(ready(F.col("place")), F.lit("words " * 50)).otherwise(F.lit("")))
    return vendors, enrich, lambda df: df.withColumn("capability_match_score", score(F.col("place"))).withColumn("scoring_method", F.lit("llm"))


@pytest.mark.parametrize("case", ["all", "poor first", "fades"])
def test_two_in_flight_give_the_same(spark, case):
    ready = {"all": lambda p: F.lit(True), "poor first": lambda p: p >= 140, "fades": lambda p: F.lit(True)}[case]
    score = {"all": lambda p: F.when(p % 5 == 0, 60.0).otherwise(10.0), "poor first": lambda p: F.lit(50.0), "fades": lambda p: F.when(p < 100, 50.0).otherwise(0.0)}[case]
    vendors, enrich, scorer = gate_inputs(spark, 430, ready, score)
    gate = batches.Gate(target=500) if case != "all" else batches.Gate(target=30)
    one, two = batches.run_gated(vendors, enrich, scorer, gate), batches.run_gated_ahead(vendors, enrich, scorer, gate)
    assert one.trace == two.trace and one.relevant == two.relevant
    for a, b in zip(one.scored, two.scored):
        assert sorted(a.collect()) == sorted(b.collect())


def test_what_is_not_needed_is_cancelled(spark):
    slow = F.udf(lambda p: time.sleep(1.0 * (p >= 100)) is None, "boolean")
    vendors, enrich, scorer = gate_inputs(spark, 400, lambda p: F.lit(True), lambda p: F.lit(90.0))
    late = lambda df: enrich(df).where(slow(F.col("place")))
    began = time.time()
    out = batches.run_gated_ahead(vendors, late, scorer, batches.Gate(target=50))
    assert out.trace == [(0, 100, 100, 100)] and len(out.cancelled) == 1 and out.cancelled[0].endswith("-100")
    assert time.time() - began < 60  # the batch that was cancelled would take as many seconds in each of its steps
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    ids = list(tracker.getJobIdsForTag(out.cancelled[0]))
    states = {str(spark.sparkContext.statusTracker().getJobInfo(i).status) for i in ids}
    assert ids and "FAILED" in states
