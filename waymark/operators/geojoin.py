"""Radius search and radius / nearest-facility joins.

Positions are points in space, and a radius join is an equi-join on cubes of a grid with an exact filter, whatever the latitude. The grid has levels, whose edges are powers of
two of FINEST: an origin looks in the level of its own reach, in the two or three cubes along each axis that its reach touches, so that what it meets goes with its reach
and not with the largest one. Facilities are in one cube of each level that some origin uses.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import RADIUS, arc, chord, chord_of, point
from waymark.functions.text import canonical_service, services
from waymark.operators.stored import kept

XYZ = ("_x", "_y", "_z")
#: The edge of the finest cubes in metres.
FINEST = 1000.0


def located(rows: DataFrame) -> DataFrame:
    """Rows with coordinates (0.0 is one), and their points."""
    p = point(F.col("lat"), F.col("lng"))
    return rows.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumns(dict(zip(XYZ, p, strict=True)))


def optional(condition, value) -> Column:
    """A predicate that holds for every row if its argument isn't given."""
    return F.lit(True) if value is None else condition(value)


def radius_search(facilities: DataFrame, lat: float, lng: float, metres: float = 50_000, uf: str | None = None, service: str | None = None, limit: int = 50) -> DataFrame:
    """Facilities within metres of a point, nearest first: a box on the stored point, then the exact distance."""
    at = [F.lit(v) for v in _constants(lat, lng)]
    reach = chord_of(metres) + 1e-6
    near = located(facilities)
    for c, v in zip(XYZ, at, strict=True):
        near = near.where(F.col(c).between(v - reach, v + reach))
    near = near.withColumn("distance_m", arc(chord(tuple(F.col(c) for c in XYZ), tuple(at))))
    near = near.where(F.col("distance_m") <= metres)
    near = near.where(optional(lambda v: F.col("uf") == v.upper(), uf)).where(optional(lambda v: F.array_contains(services(F.col("atendimentos_raw")), v), service))
    return near.drop(*XYZ).orderBy("distance_m", "id").limit(limit)


def _constants(lat: float, lng: float) -> tuple[float, float, float]:
    a, b = math.radians(lat), math.radians(lng)
    return RADIUS * math.cos(a) * math.cos(b), RADIUS * math.cos(a) * math.sin(b), RADIUS * math.sin(a)


def candidates(origins: DataFrame, facilities: DataFrame, metres: float = 50_000, most: float = 200_000) -> DataFrame:
    """The pairs that radius_join measures: origin_id, id and what the filters need, for all facilities in the cubes that an origin's reach touches."""
    asked = [_reach(origins, metres, most).alias("_metres"), *_wanted(origins)]
    there = located(origins).select("origin_id", *asked, *[F.col(c).alias(f"o{c}") for c in XYZ]).where("_metres >= 0")
    span = F.lit(2 * RADIUS) * F.sin(F.least(F.lit(math.pi / 2), F.col("_metres") / (2 * RADIUS))) + 1e-6
    there = there.withColumn("_span", span).withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.col("_span") / FINEST))).cast("int"))
    levels = sorted(r[0] for r in there.select("_level").distinct().collect())  # 15 at most: the sphere's diameter is the longest chord
    edge = F.lit(FINEST) * F.pow(F.lit(2.0), F.col("_level"))
    here = located(facilities).withColumn("_level", F.explode(F.array(*map(F.lit, levels or [0]))))
    cells = []
    for c in XYZ:
        cells.append(f"_cell{c}")
        touched = F.sequence(F.floor((F.col(f"o{c}") - F.col("_span")) / edge), F.floor((F.col(f"o{c}") + F.col("_span")) / edge))
        there = there.withColumn(cells[-1], F.explode(touched))
        here = here.withColumn(cells[-1], F.floor(F.col(c) / edge))
    read = [F.col("uf")] * ("uf" in origins.columns) + [services(F.col("atendimentos_raw")).alias("_services")] * ("service" in origins.columns)
    cubes, width = ["_level", *cells], _width(origins)
    return there.repartition(width, *cubes).join(here.select("id", *XYZ, *cubes, *read).repartition(width, *cubes), cubes)


def radius_join(origins: DataFrame, facilities: DataFrame, metres: float = 50_000, k: int | None = None, most: float = 200_000, decimals: int | None = None) -> DataFrame:
    """origin_id, id, distance_m (and rank) of all pairs within reach; with k, each origin's k nearest of them.

    Origins may have a reach of their own (metres, at most `most`; null: the argument; below 0: nothing), a state (uf, in either case) and a service (any of its names; one
    that is unknown fits no facility); null asks for nothing. Without k, distances are measured between distinct places, and origins and facilities are put to them at the end, so that only the
    pairs themselves go with the product of both tables. With k, see _nearest. decimals: to how many the distances are rounded, once they are compared.
    """
    reach = _reach(origins, metres, most)
    shown = F.col("distance_m") if decimals is None else F.round("distance_m", decimals)
    if k is not None:
        return _nearest(origins.withColumn("metres", reach), facilities, k, most).withColumn("distance_m", shown)
    asked = origins.withColumn("metres", reach).where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    here = facilities.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    from_place, to_place = F.struct("lat", "lng", "metres").alias("origin_id"), F.struct("lat", "lng").alias("id")
    starts, ends = asked.select("lat", "lng", "metres").distinct(), here.select("lat", "lng").distinct()
    near = _measured(starts.select(from_place, "lat", "lng", "metres"), ends.select(to_place, "lat", "lng"), most)
    near = near.select(F.col("origin_id.lat").alias("_olat"), F.col("origin_id.lng").alias("_olng"), F.col("origin_id.metres").alias("metres"), F.col("id.lat").alias("lat"), F.col("id.lng").alias("lng"), shown.alias("distance_m"))
    own = asked.select(F.col("lat").alias("_olat"), F.col("lng").alias("_olng"), "metres", "origin_id", *_wanted(asked))
    width = _width(origins)
    met = near.join(own, ["_olat", "_olng", "metres"]).repartition(width, "lat", "lng")
    read = [F.col("uf")] * ("uf" in origins.columns) + [services(F.col("atendimentos_raw")).alias("_services")] * ("service" in origins.columns)
    pairs = met.join(here.select("id", "lat", "lng", *read).repartition(width, "lat", "lng"), ["lat", "lng"])
    return _fitting(pairs).select("origin_id", "id", "distance_m")


def _nearest(origins: DataFrame, facilities: DataFrame, k: int, most: float) -> DataFrame:
    """Each origin's k nearest facilities within its reach (metres).

    Origins look near by first, and those that find fewer than k, and could look further, look twice as far: so what an origin meets goes with k and with how often its state and service occur, not
    with all that its reach holds. The first look is as far as the cubes of a level whose cubes hold two places each. Twenty looks or so are the most, whatever the tables.
    """
    left = kept(origins.where("metres >= 0"), "origins")
    furthest = left.agg(F.max("metres")).first()[0]
    look = _first_look(facilities, furthest or 0.0)
    parts = []
    while furthest is not None:
        pairs = _fitting(_measured(left.withColumns({"_own": F.col("metres"), "metres": F.least("metres", F.lit(look))}), facilities, most))
        found = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("origin_id").orderBy("distance_m", "id"))).where(F.col("rank") <= k)
        found = kept(found.select("origin_id", "id", "distance_m", "rank"), "nearest")
        if look >= furthest:
            parts.append(found)
            break
        full = found.where(F.col("rank") == k).select("origin_id")
        over = full.unionByName(left.where(F.col("metres") <= look).select("origin_id")).distinct()
        parts.append(found.join(over, "origin_id", "left_semi"))
        left = kept(left.join(over, "origin_id", "left_anti"), "origins")
        furthest = left.agg(F.max("metres")).first()[0]
        look *= 2
    if not parts:
        return _fitting(_measured(left, facilities, most)).select("origin_id", "id", "distance_m").withColumn("rank", F.lit(1))
    return functools.reduce(DataFrame.unionByName, parts)


def _first_look(facilities: DataFrame, furthest: float) -> float:
    levels = max(1, math.ceil(math.log2(max(furthest, FINEST) / FINEST)))
    cubes = [F.approx_count_distinct(F.struct(*[F.floor(F.col(c) / (FINEST * 2.0**i)) for c in XYZ])).alias(f"n{i}") for i in range(levels)]
    places, *held = located(facilities).agg(F.approx_count_distinct(F.struct("lat", "lng")), *cubes).first()
    return FINEST * 2.0 ** next((i for i, n in enumerate(held) if places >= 2 * n > 0), levels)


def _reach(origins: DataFrame, metres: float, most: float) -> Column:
    own = F.coalesce("metres", F.lit(float(metres))) if "metres" in origins.columns else F.lit(float(metres))
    return F.least(own.cast("double"), F.lit(float(most))) if "metres" in origins.columns else own


def _wanted(origins: DataFrame) -> list[Column]:
    """What origins ask of a facility: _uf, and _service with _any_service."""
    service = [canonical_service(F.col("service")).alias("_service"), F.col("service").isNull().alias("_any_service")]
    return [F.upper("uf").alias("_uf")] * ("uf" in origins.columns) + service * ("service" in origins.columns)


def _measured(origins: DataFrame, facilities: DataFrame, most: float) -> DataFrame:
    """candidates with distance_m, those within reach."""
    d = arc(chord(tuple(F.col(c) for c in XYZ), tuple(F.col(f"o{c}") for c in XYZ)))
    return candidates(origins, facilities, most=most).withColumn("distance_m", d).where(F.col("distance_m") <= F.col("_metres"))


def _fitting(pairs: DataFrame) -> DataFrame:
    """The pairs whose facility is of the state and has the service that its origin asks for."""
    if "_uf" in pairs.columns:
        pairs = pairs.where(F.col("_uf").isNull() | (F.col("_uf") == F.col("uf")))
    if "_service" in pairs.columns:
        pairs = pairs.where(F.col("_any_service") | F.coalesce(F.array_contains("_services", F.col("_service")), F.lit(False)))
    return pairs


def _width(rows: DataFrame) -> int:
    """How many partitions a join has whose output is far more than its input, which adaptive execution would put into few."""
    return 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


TABLE_FUNCTION = """
CREATE OR REPLACE TEMPORARY FUNCTION facilities_near(p_lat DOUBLE, p_lng DOUBLE, p_metres DOUBLE DEFAULT 50000, p_uf STRING DEFAULT NULL, p_service STRING DEFAULT NULL, p_limit INT DEFAULT 50)
RETURNS TABLE (id INT, uf STRING, municipio STRING, distance_m DOUBLE)
RETURN SELECT id, uf, municipio, distance_m FROM (
  SELECT *, row_number() OVER (ORDER BY distance_m, id) AS place FROM (
    SELECT *, {diameter}D * asin(least(1.0D, sqrt(pow(_x - at_x, 2) + pow(_y - at_y, 2) + pow(_z - at_z, 2)) / {diameter}D)) AS distance_m FROM (
      SELECT f.*, {radius}D * cos(radians(p_lat)) * cos(radians(p_lng)) AS at_x, {radius}D * cos(radians(p_lat)) * sin(radians(p_lng)) AS at_y, {radius}D * sin(radians(p_lat)) AS at_z,
        {diameter}D * sin(least(pi() / 2, p_metres / {diameter}D)) + 0.000001D AS reach
      FROM facilities f WHERE (p_uf IS NULL OR f.uf = upper(p_uf)) AND (p_service IS NULL OR array_contains(f._services, p_service))) c
    WHERE _x BETWEEN at_x - reach AND at_x + reach AND _y BETWEEN at_y - reach AND at_y + reach AND _z BETWEEN at_z - reach AND at_z + reach) d
  WHERE distance_m <= p_metres) r WHERE place <= p_limit"""


def register_table_function(facilities: DataFrame) -> None:
    """facilities_near(lat, lng, metres, uf, service, limit) for SQL, over facilities: a box on the points, then the exact distance.

    It reads the view `facilities`, which has the points and services beside the table's columns; a table that stores them is read with its box pushed down.
    """
    located(facilities).withColumn("_services", services(F.col("atendimentos_raw"))).createOrReplaceTempView("facilities")
    facilities.sparkSession.sql(TABLE_FUNCTION.format(radius=RADIUS, diameter=2 * RADIUS))
