"""Places: tiers, scores, distances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..refdata import CANADA_NEIGHBOURS, STATE_CENTRES, TOWN_PLACES, US_NEIGHBOURS
from .cleaning import city_key, state_code

EARTH_MILES = 3958.7613
# The WGS-84 ellipsoid and the mile.
EQUATOR_METRES, FLATTENING, MILE_METRES = 6378137.0, 1 / 298.257223563, 1609.344


def is_neighbour(tender_state: Column, vendor_state: Column, country: Column) -> Column:
    """Whether the tender's region lists the vendor's as a neighbour, in the table of the tender's country. Pairs of regions are looked up in a hash set."""
    pair = F.concat(tender_state, F.lit("|"), vendor_state)
    listed = lambda table: pair.isin([f"{k}|{x}" for k, v in table.items() for x in v])
    row = F.when(F.contains(F.coalesce(country, F.lit("")), F.lit("Canada")), listed(CANADA_NEIGHBOURS)).otherwise(listed(US_NEIGHBOURS))
    return F.coalesce(row, F.lit(False))


def geo_tier(tender_state: Column, vendor_state: Column, country: Column) -> Column:
    t, v = state_code(tender_state), state_code(vendor_state)
    return F.when(t == v, "local").when(is_neighbour(t, v, country), "regional").otherwise("national")


def geo_score(tender_city: Column, tender_state: Column, vendor_state: Column, country: Column, local: float = 20.0, regional: float = 10.0) -> Column:
    """As the tier, but nothing without the tender's city."""
    t, v = state_code(tender_state), state_code(vendor_state)
    return F.when(city_key(tender_city).isNull() | v.isNull(), 0.0).when(t == v, local).when(is_neighbour(t, v, country), regional).otherwise(0.0)


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "local", 0).when(tier == "regional", 1).otherwise(2)


def sphere_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the mean sphere, within 0.6 % of the one on the ellipsoid."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _geodesic(azimuth: np.ndarray, sb1: np.ndarray, cb1: np.ndarray, sb2: np.ndarray, cb2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The geodesic that leaves reduced latitude b1 with this azimuth, up to where it reaches b2: longitude covered, and metres."""
    f = FLATTENING
    s0, c1 = np.sin(azimuth) * cb1, np.cos(azimuth)
    s1, s2 = np.arctan2(sb1, c1 * cb1), np.arctan2(sb2, np.sqrt(np.maximum(0.0, (c1 * cb1) ** 2 + cb2**2 - cb1**2)))
    arc, mid, c2 = s2 - s1, np.cos(s1 + s2), 1 - s0 * s0
    c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
    on_sphere = np.arctan2(s0 * np.sin(s2), np.cos(s2)) - np.arctan2(s0 * np.sin(s1), np.cos(s1))
    longitude = on_sphere - (1 - c) * f * s0 * (arc + c * np.sin(arc) * (mid + c * np.cos(arc) * (2 * mid * mid - 1)))
    u2 = c2 * (1 / (1 - f) ** 2 - 1)
    scale = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    less = b * np.sin(arc) * (mid + b / 4 * (np.cos(arc) * (2 * mid * mid - 1) - b / 6 * mid * (4 * np.sin(arc) ** 2 - 3) * (4 * mid * mid - 3)))
    return longitude, EQUATOR_METRES * (1 - f) * scale * (arc - less)


def geodesic_miles(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Distances on the ellipsoid; NaN for places without coordinates.

    The longitude that a geodesic covers until it reaches the second latitude grows with the azimuth at the first point (the one
    farther from the equator, taken as southern), so the azimuth is found by 52 halvings, for antipodes as for neighbours. Points within a metre of
    the equator lie on it unless they are nearly opposite."""
    span = np.abs(np.radians(lon1 - lon2)) % (2 * math.pi)
    span = np.where(span > math.pi, 2 * math.pi - span, span)
    first = np.abs(lat1) >= np.abs(lat2)
    far, near = np.where(first, lat1, lat2), np.where(first, lat2, lat1)
    b1, b2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x))) for x in (np.minimum(-np.abs(far), -1e-5), np.where(far > 0, -near, near)))
    parts = np.sin(b1), np.cos(b1), np.sin(b2), np.cos(b2)
    low, high = np.zeros(len(span)), np.full(len(span), math.pi)
    for _ in range(52):
        middle = (low + high) / 2
        short = _geodesic(middle, *parts)[0] < span
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    metres = _geodesic((low + high) / 2, *parts)[1]
    metres = np.where((np.abs(far) < 1e-5) & (span <= (1 - FLATTENING) * math.pi), EQUATOR_METRES * span, metres)
    return np.where((lat1 == lat2) & (span == 0), 0.0, metres) / MILE_METRES


@F.pandas_udf(DoubleType())
def _miles(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(geodesic_miles(*(x.to_numpy(np.float64) for x in (lat1, lon1, lat2, lon2))))


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the WGS-84 ellipsoid in miles; a place without coordinates is 999999 away. In whole Arrow batches: the same halvings as
    column expressions, which lambdas would have to carry, take some hundred times as long."""
    found = _miles(*(x.cast("double") for x in (lat1, lon1, lat2, lon2)))
    return F.when(found.isNull() | F.isnan(found), 999999.0).otherwise(found)


def located(city: Column, state: Column) -> Column:
    """Latitude and longitude as a struct: of the town if it is listed, else of the middle of its state, else null."""
    towns = F.create_map(*[x for (c, s), p in TOWN_PLACES.items() for x in (F.lit(f"{c}|{s}"), F.struct(F.lit(p[0]).alias("lat"), F.lit(p[1]).alias("lon")))])
    states = F.create_map(*[x for s, p in STATE_CENTRES.items() for x in (F.lit(s), F.struct(F.lit(p[0]).alias("lat"), F.lit(p[1]).alias("lon")))])
    key = F.concat(F.upper(F.trim(city)), F.lit("|"), F.upper(F.trim(state)))
    return F.coalesce(F.try_element_at(towns, key), F.try_element_at(states, state))


def distance_score(distance: Column, far: bool = True) -> Column:
    """Bands of distance in miles; far: 0.1 up to 3000 and 0.05 beyond, else 0.1 for all that is far."""
    out = F.when(distance <= 50, 1.0).when(distance <= 200, 0.9).when(distance <= 500, 0.7).when(distance <= 1000, 0.5).when(distance <= 2000, 0.3)
    return out.when(distance <= 3000, 0.1).otherwise(0.05) if far else out.otherwise(0.1)
