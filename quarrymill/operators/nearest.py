"""The nearest of many entities, exactly, by distance on the ellipsoid.

Entities lie on a grid of cells of `cell` degrees, by default such that a cell holds about 2 k of them: the pairs of a question and the entities in
its cells stay as many when entities grow in number. How many a cell holds is counted first: these counts are one row per occupied cell, at
most 180 * 360 / cell^2 rows whatever the input, and go to every task. Questions at one place are answered once. A question takes cells in the order of the farthest that their
entities can be, until they hold k; that bounds the k-th distance, and only cells that can be nearer than this bound are joined. The rings
that a question reaches therefore grow where entities are few and end at once where they are many.

A cell may hold most of the entities, as when an address is known to its town only: of entities at the same place only the k
first by key can be among the k nearest, so these alone are kept. Entities without coordinates are 999999 miles away: they form one more
cell, after all others, of which again k rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_MILES, located, miles
from ..session import checkpointed

UNKNOWN = -1  # the cell of entities without coordinates
MOST_CELLS = 1 << 18  # that a finer grid may have, as they go to every task
SPREAD = 0.006  # the sphere's distances differ from the ellipsoid's by less than this share


def cell_of(lat: Column, lon: Column, cell: float) -> Column:
    """The number of a place's cell; longitudes that differ by whole turns are the same."""
    turned = F.pmod(lon + 180.0, F.lit(360.0))
    across = int(np.ceil(360 / cell))
    return F.coalesce((F.floor((lat + 90.0) / cell) * across + F.floor(turned / cell)).cast("long"), F.lit(UNKNOWN))


def _sphere(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_MILES * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))  # middles of the last cells lie beyond the pole


def _sphere_of(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _shape(number: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middles of cells, and the farthest that a place in the cell is from them."""
    across = int(np.ceil(360 / cell))
    south, west = number // across * cell - 90.0, number % across * cell - 180.0
    lat, lon = south + cell / 2, west + cell / 2
    radius = np.max([_sphere(lat, lon, np.clip(south + a * cell, -90, 90), west + b * cell) for a in (0, 1) for b in (0, 1)], axis=0)
    # a cell that the equator runs along is widest at its side, not in its corners
    return lat, lon, np.maximum(radius, np.radians(cell) * EARTH_MILES * 0.75)


class Cells:
    """Occupied cells: middles, the farthest that a corner is from the middle, and how many entities they hold."""

    def __init__(self, counts: dict[int, int], cell: float):
        self.cell = cell
        self.number = np.array(sorted(counts), np.int64)
        self.count = np.array([counts[c] for c in self.number.tolist()], np.int64)
        self.unknown = self.number == UNKNOWN
        self.lat, self.lon, self.radius = _shape(self.number, cell)

    def _reach(self, lat: np.ndarray, lon: np.ndarray, around: float, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For questions within `around` miles of each of these places: (place, cell) as indices, and how far the k-th nearest of a place can be."""
        away = _sphere(self.lat[among], self.lon[among], lat[:, None], lon[:, None])
        unknown, radius = self.unknown[among], self.radius[among] + around
        farthest = np.where(unknown, np.inf, (away + radius) * (1 + SPREAD))
        nearest = np.where(unknown, np.inf, np.maximum(0.0, away - radius) * (1 - SPREAD))
        order = np.argsort(farthest, axis=1, kind="stable")
        enough = np.minimum((np.cumsum(self.count[among][order], axis=1) < k).sum(axis=1), len(among) - 1)
        limit = np.take_along_axis(farthest, np.take_along_axis(order, enough[:, None], 1), 1)
        place, cell = np.nonzero(nearest <= limit)
        return place, among[cell], limit[:, 0]

    def reach(self, lat: float, lon: float, k: int) -> np.ndarray:
        """The cells that can hold one of the k nearest."""
        return self.number[self._reach(np.array([lat]), np.array([lon]), 0.0, np.arange(len(self.number)), k)[1]]

    def reaches(self, lat: np.ndarray, lon: np.ndarray, number: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For places that lie in the cells `number`: (place, cell, limit) in lots; the cells can hold one of the k nearest of the place, none of
        which is farther than the limit. What a whole cell of places can reach is worked out first, and only that for each place."""
        own = np.unique(number)
        middle = _shape(own, self.cell)
        for i, n in enumerate(own):
            at = np.flatnonzero(number == n)
            _, among, _ = self._reach(middle[0][i : i + 1], middle[1][i : i + 1], middle[2][i], np.arange(len(self.number)), k)
            step = max(1, (1 << 20) // len(among))
            for lot in (at[j : j + step] for j in range(0, len(at), step)):
                place, cell, limit = self._reach(lat[lot], lon[lot], 0.0, among, k)
                yield lot[place], self.number[cell], limit[place]


def _cell_size(held: DataFrame, k: int) -> float:
    """The width of cells of which one holds about 2 k entities, where an entity lies on average; from one degree down, while cells stay few."""
    cell = 1.0
    s = held.where("lat is not null").groupBy(cell_of(F.col("lat"), F.col("lon"), cell)).count().agg(F.sum(F.col("count").cast("double") ** 2), F.sum("count"), F.count("*")).first()
    crowd, occupied = (s[0] / s[1], s[2]) if s[1] else (0.0, 0)
    while crowd > 2 * k and occupied * 4 <= MOST_CELLS:
        cell, crowd, occupied = cell / 2, crowd / 4, occupied * 4
    return cell


def nearest(questions: DataFrame, entities: DataFrame, k: int = 10, cell: float | None = None) -> DataFrame:
    """questions: (question, lat, lon); entities: (key, lat, lon). (question, key, miles, place) with the k nearest entities of every question
    that has coordinates, ties by key, those without coordinates last."""
    known = F.col("lat").between(-90, 90) & F.col("lon").isNotNull() & ~F.isnan("lon")
    spot = lambda c: F.when(known, F.col(c).cast("double"))
    rows = entities.select("key", spot("lat").alias("lat"), spot("lon").alias("lon"))
    first = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("key"))
    held = checkpointed(rows.withColumn("_n", first).where(F.col("_n") <= k).drop("_n"))
    cell = cell or _cell_size(held, k)
    held = held.withColumn("cell", cell_of(F.col("lat"), F.col("lon"), cell))
    counts = {r.cell: r.n for r in held.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per cell
    cells = Cells(counts, cell)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lat, lon, own = b["qlat"].to_numpy(), b["qlon"].to_numpy(), b["qcell"].to_numpy()
            for place, number, limit in cells.reaches(lat, lon, own, k):
                yield pd.DataFrame({"qlat": lat[place], "qlon": lon[place], "cell": number, "limit": limit})

    asked = questions.where(known).select("question", spot("lat").alias("qlat"), spot("lon").alias("qlon"))
    if not counts:
        return asked.limit(0).select("question", F.lit(None).cast(entities.schema["key"].dataType).alias("key"), F.lit(0.0).alias("miles"), F.lit(0).alias("place"))
    parts = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as a few rows here are much work
    # questions at one place have one answer; those of a cell come together
    places = asked.select("qlat", "qlon").distinct().withColumn("qcell", cell_of(F.col("qlat"), F.col("qlon"), cell)).repartitionByRange(parts, "qcell", "qlat", "qlon")
    reached = places.mapInPandas(spread, "qlat double, qlon double, cell long, limit double")
    near = F.col("lat").isNull() | (_sphere_of(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")) * (1 - SPREAD) <= F.col("limit"))
    pairs = reached.join(held, "cell").where(near).withColumn("miles", miles(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")))
    place = F.row_number().over(Window.partitionBy("qlat", "qlon").orderBy("miles", "key"))
    best = pairs.withColumn("place", place).where(F.col("place") <= k).select("qlat", "qlon", "key", "miles", "place")
    return asked.join(best, ["qlat", "qlon"]).select("question", "key", "miles", "place")


def estimated(entities: DataFrame, lat: float, lon: float, city: str = "city", state: str = "state") -> DataFrame:
    """entities with distance_miles from a place, by their town or the middle of their state, to hundredths of a mile; 999999 where neither is known."""
    at = entities.withColumn("_at", located(F.col(city), F.col(state)))
    return at.withColumn("distance_miles", F.round(miles(F.lit(lat), F.lit(lon), F.col("_at.lat"), F.col("_at.lon")), 2)).drop("_at")


def by_distance(entities: DataFrame, lat: float, lon: float, key: str, city: str = "city", state: str = "state") -> DataFrame:
    """entities from near to far, with distance_miles and distance_score; without a state the score is 0."""
    from ..functions.geo import distance_score

    out = estimated(entities, lat, lon, city, state)
    given = F.coalesce(F.col(state), F.lit("")) != ""
    out = out.withColumn("distance_miles", F.when(given, F.col("distance_miles")).otherwise(999999.0)).withColumn("distance_score", F.when(given, distance_score(F.col("distance_miles"), far=False)).otherwise(0.0))
    return out.orderBy("distance_miles", key)
