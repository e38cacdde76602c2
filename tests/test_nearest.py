import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrymill.functions import geo
from quarrymill.operators.nearest import by_distance, nearest


def vincenty(lat1, lon1, lat2, lon2):
    """Metres by the usual iteration on the longitude; None where it does not settle."""
    a, f = 6378137.0, 1 / 298.257223563
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    lon = lam = math.radians((lon2 - lon1 + 540) % 360 - 180)
    for _ in range(300):
        ss = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if ss == 0:
            return 0.0
        cs = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        s, sa = math.atan2(ss, cs), math.cos(u1) * math.cos(u2) * math.sin(lam) / ss
        c2 = 1 - sa * sa
        m = cs - 2 * math.sin(u1) * math.sin(u2) / c2 if c2 else 0.0
        c, old = f / 16 * c2 * (4 + f * (4 - 3 * c2)), lam
        lam = lon + (1 - c) * f * sa * (s + c * ss * (m + c * cs * (2 * m * m - 1)))
        if abs(lam) > math.pi:
            return None
        if abs(lam - old) < 1e-13:
            break
    else:
        return None
    v = c2 * (1 / (1 - f) ** 2 - 1)
    big = 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v)))
    b = v / 1024 * (256 + v * (-128 + v * (74 - 47 * v)))
    return a * (1 - f) * big * (s - b * ss * (m + b / 4 * (cs * (2 * m * m - 1) - b / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3))))


def test_ellipsoid():
    rng = np.random.default_rng(1)
    at = np.column_stack([rng.uniform(-90, 90, 1500), rng.uniform(-180, 180, 1500), rng.uniform(-90, 90, 1500), rng.uniform(-180, 180, 1500)])
    near = at[:300, :2].clip(-89, 89)
    at = np.vstack([at, np.hstack([near, near + rng.uniform(-0.01, 0.01, near.shape)])])
    got, checked = geo.geodesic_miles(*at.T), 0
    for row, m in zip(at.tolist(), got):
        expected = vincenty(*row)
        if expected is not None:
            assert abs(expected / geo.MILE_METRES - m) < 1e-6
            checked += 1
    assert checked > 1700


def test_antipodes_poles_and_equator():
    # published lengths: half a meridian, and the usual hard case near the antipode
    cases = [((0, 0, 0, 180), 20003931.4586), ((0, 0, 0.5, 179.5), 19936288.5790), ((90, 0, -90, 50), 20003931.4586), ((30, 0, -30, 180), 20003931.4586), ((0, 0, 0, 90), math.pi / 2 * 6378137), ((0, 0, 0, 0), 0), ((45, 10, 45, 370), 0)]
    got = geo.geodesic_miles(*np.array([c for c, _ in cases], float).T) * geo.MILE_METRES
    assert got == pytest.approx([m for _, m in cases], abs=1.5)
    assert got[5] == got[6] == 0


def test_nearest_against_all_pairs(spark):
    rng = random.Random(5)
    places = [(f"e{i:04d}", rng.choice([rng.uniform(-90, 90), rng.gauss(40, 3)]), rng.choice([rng.uniform(-180, 180), rng.gauss(-75, 4), 179.99, -179.99])) for i in range(600)]
    places += [(f"hot{i:03d}", 40.5, -75.5) for i in range(300)] + [(f"none{i:02d}", None, -75.0) for i in range(30)] + [("bad", 91.0, 0.0), ("edge", 90.0, 0.0), ("south", -90.0, 12.0)]
    asked = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(25)] + [(100, 40.5, -75.5), (101, 0.0, 180.0), (102, 90.0, 0.0), (103, None, 1.0), (104, -12.0, -180.0)]
    e, q = spark.createDataFrame(places, "key string, lat double, lon double"), spark.createDataFrame(asked, "question int, lat double, lon double")
    at = np.array([[x if x is not None else math.nan for x in p[1:]] for p in places])
    at[(at[:, 0] > 90), 0] = math.nan
    for k, cell in ((7, 1.0), (3, 10.0), (40, 2.5)):
        got = {}
        for r in nearest(q, e, k, cell).collect():
            got.setdefault(r.question, []).append((r.place, r.key, round(r.miles, 6)))
        assert set(got) == {a[0] for a in asked if a[1] is not None}
        for i, lat, lon in asked:
            if lat is not None:
                d = geo.geodesic_miles(np.full(len(at), lat), np.full(len(at), lon), *at.T)
                d = np.where(np.isnan(d), 999999.0, d)
                best = sorted(range(len(at)), key=lambda j: (d[j], places[j][0]))[:k]
                assert sorted(got[i]) == [(n + 1, places[j][0], round(float(d[j]), 6)) for n, j in enumerate(best)]


def test_unknown_places_come_last(spark):
    e = spark.createDataFrame([("a", None, None), ("b", 1.0, 1.0), ("c", None, 2.0), ("d", None, None)], "key string, lat double, lon double")
    q = spark.createDataFrame([("x", 0.0, 0.0)], "question string, lat double, lon double")
    assert [(r.key, r.miles == 999999.0) for r in nearest(q, e, 3).orderBy("place").collect()] == [("b", False), ("a", True), ("c", True)]
    assert nearest(q, e.limit(0)).collect() == nearest(q.limit(0), e).collect() == []


def test_few_cells_are_reached(spark):
    from quarrymill.operators.nearest import Cells

    cells = Cells({i: 50 for i in range(180 * 360)}, 1.0)
    assert max(len(cells.reach(lat, -75.3, 10)) for lat in (0.0, 45.2, -60.0)) < 60


def test_work_grows_with_places_not_with_their_square(spark, monkeypatch):
    """Distances worked out: a bounded number for each place that is asked about, however many ask and however dense entities lie."""
    from pyspark.sql.functions import pandas_udf

    from quarrymill.operators import nearest as N

    done = spark.sparkContext.accumulator(0)

    @pandas_udf("double")
    def counted(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        done.add(len(lat1))
        return pd.Series(geo.geodesic_miles(*(x.to_numpy(float) for x in (lat1, lon1, lat2, lon2))))

    monkeypatch.setattr(N, "miles", lambda *c: counted(*c))
    rng = np.random.default_rng(3)
    at = rng.uniform(0, 1, (2000, 2)) + [40, -75]
    e = spark.createDataFrame([(f"e{i:04d}", float(a), float(o)) for i, (a, o) in enumerate(at)], "key string, lat double, lon double")
    q = spark.createDataFrame([(i, 40.0 + i % 20 / 20, -74.5) for i in range(400)], "question int, lat double, lon double")
    got = {(r.question, r.place): r.key for r in nearest(q, e, 3).collect()}
    assert len(got) == 1200 and all(got[i, n] == got[i % 20, n] for i in range(400) for n in (1, 2, 3))
    for i in range(20):
        d = geo.geodesic_miles(np.full(2000, 40.0 + i / 20), np.full(2000, -74.5), *at.T)
        assert [got[i, n] for n in (1, 2, 3)] == [f"e{j:04d}" for j in np.argsort(d)[:3]]
    assert done.value < 20 * 200  # 800,000 pairs before


def test_estimates(spark):
    rows = [(1, "Santa Fe ", "NM"), (2, "Nowhere", "NM"), (3, None, "TX"), (4, "Paris", "FR"), (5, "Toronto", None), (6, "x", "")]
    got = by_distance(spark.createDataFrame(rows, "id int, city string, state string"), 35.0844, -106.6504, "id").collect()
    assert [r.id for r in got] == [2, 1, 3, 4, 5, 6] or [r.id for r in got] == [1, 2, 3, 4, 5, 6]
    by = {r.id: (r.distance_miles, r.distance_score) for r in got}
    assert by[1][0] == pytest.approx(vincenty(35.0844, -106.6504, 35.6870, -105.9378) / 1609.344, abs=0.006)
    assert by[4] == (999999.0, 0.1) and by[5] == by[6] == (999999.0, 0.0) and by[1][1] == 0.9
    assert [r[0] for r in spark.range(1).select(F.round(geo.miles(F.lit(None), F.lit(1), F.lit(2), F.lit(3)), 1)).collect()] == [999999.0]


def test_sam_entities_by_code_and_distance(spark, tmp_path):
    import json

    from quarrymill.sources import feeds

    def entity(uei, city, state, *codes):
        core = {"physicalAddress": {"city": city, "stateOrProvinceCode": state}, "entityInformation": {"entityURL": "u"}, "businessTypes": {"businessTypeList": [{"businessTypeDesc": "Small Business"}]}}
        poc = {p: {"firstName": "A", "lastName": "B", "email": "a@b.c"} for p in ("governmentBusinessPOC", "electronicBusinessPOC", "pastPerformancePOC")}
        return {"entityRegistration": {"ueiSAM": uei, "cageCode": "c", "legalBusinessName": f"N{uei}", "pointsOfContact": poc}, "coreData": core, "assertions": {"goodsAndServices": {"naicsList": [{"naicsCode": c} for c in codes]}}}

    data = [entity("u1", "Austin", "TX", "238220"), entity("u2", "Santa Fe", "NM", "238220", "541"), entity("u3", "Roswell", "NM", "111"), entity("u4", "?", "ZZ", "2382"), entity("u5", "Boston", "MA", "238")]
    (tmp_path / "p.json").write_text(json.dumps({"entityData": data}))
    payload = spark.read.json(str(tmp_path / "p.json"))
    got = feeds.sam_entities(payload, naics=["238"], project=(35.0844, -106.6504), limit=3).collect()
    assert [r.uei for r in got] == ["u2", "u1", "u5"] and got[0].distance_miles < 60
    assert [r.uei for r in feeds.sam_entities(payload, limit=2).collect()] == ["u1", "u2"]
    assert [r.uei for r in feeds.sam_entities(payload, naics=["238"], project=(0.0, 0.0)).collect()][-1] == "u4"
