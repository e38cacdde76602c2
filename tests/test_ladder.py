import random
from datetime import datetime, timedelta, timezone

import pytest

from quarrymill.streaming import flows
from quarrymill.streaming.ladder import REQUEST, ROCKS, STATE_STORE, Ladder, website_ladder

START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set(STATE_STORE, ROCKS)
    yield spark
    spark.conf.unset(STATE_STORE)


def at(minutes):
    return START + timedelta(minutes=minutes)


def play(spark, tmp_path, batches, **options):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = flows.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], REQUEST).schema)
        found = website_ladder(stream, **options)
        q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    return {(r.vendor_key, r.at): (r.level, r.website, r.confidence, r.skipped) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_ticks_of_a_clock(rocks, tmp_path):
    ok = lambda v, m, web="x.com", second=None, status=200, conf=0.8, own=None: (v, at(m), own, status, web, conf, second)
    batches = [
        [ok("a", 0), ok("b", 1, status=202, second="b2.com"), ok("c", 2, second="c2.com"), ok("d", 3, web=None)],  # b is refused: c and d skip the first source
        [ok("e", 5.9), ok("f", 6.1), ok("a", 7, web="other.com"), ok("d", 8), ok("g", 9, own="mine.com"), ok("h", 10, conf=0.4), ok("i", 11, status=403, second="i2.com")],
        [ok("d", 60 * 24 * 6), ok("d", 60 * 24 * 8), ok("a", 60 * 24 * 7 + 1, web="late.com")],  # what was found, or not, is forgotten after a week
        [ok("z", 60 * 24 * 30), ok("e", 60 * 24 * 31, web="e.com")],
    ]
    got = play(rocks, tmp_path, batches, searchers=1)
    levels = {(v, round((t - START).total_seconds() / 60, 1)): x for (v, t), x in got.items()}
    assert levels["a", 0] == ("first", "x.com", 0.8, False)
    assert levels["b", 1] == ("second", "b2.com", 0.9, False)
    assert levels["c", 2] == ("second", "c2.com", 0.9, True)
    assert levels["d", 3] == ("none", None, None, True)
    assert levels["e", 5.9] == ("none", None, None, True) and levels["f", 6.1][0] == "first"
    assert levels["a", 7] == ("cache", "x.com", 0.8, False) and levels["d", 8][:2] == ("negative", None)
    assert levels["g", 9] == ("given", "mine.com", None, False) and levels["h", 10][0] == "none" and levels["i", 11][0] == "second"
    assert levels["d", 60 * 24 * 6][0] == "negative" and levels["d", 60 * 24 * 8][0] == "first"
    assert levels["a", 60 * 24 * 7 + 1] == ("first", "late.com", 0.8, False)
    assert levels["e", 60 * 24 * 31] == ("first", "e.com", 0.8, False)


def test_random_requests_against_a_replay(rocks, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        status = rng.choice([200, 200, 200, 202, 403])
        rows.append((f"v{rng.randrange(60)}", at(i * 2 + i // 100 * 60 * 24 * 3), rng.choice([None] * 9 + ["own.com"]), status, rng.choice([None, f"f{i}.com"]), rng.choice([None, 0.3, 0.5, 0.9]), rng.choice([None, f"s{i}.com"])))
    got = play(rocks, tmp_path, [rows[:150], rows[150:300], rows[300:]], searchers=3)
    from pyspark.sql import functions as F

    homes = {r.v: r.s for r in rocks.createDataFrame([(f"v{k}",) for k in range(60)], "v string").select("v", F.pmod(F.xxhash64("v"), F.lit(3)).alias("s")).collect()}
    searchers, known, expected = {s: Ladder() for s in range(3)}, {}, {}
    for v, t, *rest in rows:
        request = dict(zip(["website", "first_status", "first_website", "first_confidence", "second_website"], rest))
        now = t.replace(tzinfo=timezone.utc).timestamp()
        level, web, conf, skipped, keep = searchers[homes[v]].answer(request, now, known.get(v))
        if keep:
            known[v] = keep
        expected[v, t] = (level, web, conf, skipped)
    assert got == expected
    assert {x[0] for x in got.values()} >= {"given", "cache", "negative", "first", "second"} and any(x[3] for x in got.values())


def test_state_store_is_needed(spark):
    with pytest.raises(RuntimeError):
        website_ladder(spark.createDataFrame([], REQUEST))
