"""Station-list operators: distances to reference points, nearest city, membership, activity
counts and name matching (J1, J2, J9, P6, P7, P14, P15).

Only the all-pairs distance table (J1) carries the city list as literals, after a size check; the
nearest city walks a quad-tree of the cities and membership is an equi-join on a grid, at any size.
No higher-order lambda is used: those run outside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EARTH_RADIUS_KM, haversine_km
from ..plans.physical import attach, materialize
from .quadtree import nearest
from .sweep import active_intervals

MAX_CITIES = 5000


def _k(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def city_rows(cities: DataFrame, name: str = "city", lat: str = "latitude", lon: str = "longitude",
              max_cities: int = MAX_CITIES) -> list[tuple]:
    """The reference points as (name, lat, lon) tuples, after checking the table is a short list.

    Raises if the table has more than ``max_cities`` rows: a larger point set is not a
    reference list, and :func:`within_radius` (a grid equi-join) is the operator for it."""
    rows = cities.select(F.col(name).cast("string"), F.col(lat).cast("double"), F.col(lon).cast("double")) \
        .limit(max_cities + 1).collect()
    if len(rows) > max_cities:
        raise ValueError(f"city table has more than {max_cities} rows; use within_radius for large point sets")
    return [tuple(r) for r in rows]


def city_array(rows: Sequence[tuple]) -> Column:
    """The reference points as one literal ``array<struct<city, lat, lon>>`` column."""
    return F.array(*[F.struct(F.lit(c).cast("string").alias("city"), F.lit(a).cast("double").alias("lat"),
                              F.lit(o).cast("double").alias("lon")) for c, a, o in rows])


def distance_pairs(stations: DataFrame, cities: DataFrame, lat: str = "latitude", lon: str = "longitude",
                   city_name: str = "city", city_lat: str = "latitude", city_lon: str = "longitude") -> DataFrame:
    """One row per (station, city) with the great-circle distance in km."""
    x = stations.withColumn("_c", F.explode(city_array(city_rows(cities, city_name, city_lat, city_lon))))
    return x.withColumn(city_name, F.col("_c.city")).withColumn(
        "distance_km", haversine_km(lat, lon, F.col("_c.lat"), F.col("_c.lon"))).drop("_c")


def nearest_city(stations: DataFrame, cities: DataFrame, lat: str = "latitude", lon: str = "longitude",
                 city_name: str = "city", out_city: str = "nearest_city", out_dist: str = "distance_km",
                 keys: Sequence[str] | None = None, city_lat: str = "latitude", city_lon: str = "longitude") -> DataFrame:
    """Every station row with its nearest city and the distance.  Ties go to the smaller city name.

    One way for city tables of any size: a quad-tree of cells built from the cities' counts, walked
    down with distance bounds (:mod:`.quadtree`), once per distinct place; the answers join back on the
    coordinates.  NULL, NaN or impossible coordinates give a station NULL city and distance and leave
    a city out; repeated station rows stay.  ``keys`` is not needed any more and has no effect."""
    best = nearest(stations, cities, lat, lon, city_name, city_lat, city_lon)
    here = (F.col(f"`{lat}`").cast("double") == F.col("_lat")) & (F.col(f"`{lon}`").cast("double") == F.col("_lon"))
    return stations.join(best, here, "left").select(
        *[F.col(f"`{c}`") for c in stations.columns if c not in (out_city, out_dist)], F.col("_ref").alias(out_city), F.col("_km").alias(out_dist))


def near_and_long(stations: DataFrame, max_km: float, min_years: float, dist: str = "distance_km",
                  years: str = "duration_years", inclusive: bool = True) -> DataFrame:
    """Stations near a city (``<=`` with ``inclusive``, else ``<``) and running long enough."""
    near = F.col(dist) <= F.lit(max_km) if inclusive else F.col(dist) < F.lit(max_km)
    return stations.where(F.coalesce(near, F.lit(False)) & (F.col(years) >= F.lit(min_years)))


def city_members(stations: DataFrame, cities: DataFrame, keys, max_km: float, lat: str = "latitude",
                 lon: str = "longitude", city_name: str = "city", city_lat: str = "latitude",
                 city_lon: str = "longitude") -> DataFrame:
    """Long-form membership: (city, station key, distance) for every station within max_km
    of a city (a station may belong to several cities)."""
    k = _k(keys)
    refs = cities.select(F.col(city_name), F.col(city_lat).alias("_rlat"), F.col(city_lon).alias("_rlon"))
    m = within_radius(stations.select(*k, lat, lon), refs, max_km, k, [city_name], lat, lon, "_rlat", "_rlon")
    return m.select(city_name, *k, "distance_km")


def _with_cells(df: DataFrame, band: str, out_n: str, band_deg: float, max_km: float) -> DataFrame:
    """Add ``out_n``, the number of longitude cells of latitude band ``band``, chosen so that each
    cell is at least as wide as the largest longitude difference of two points within ``max_km``
    when one lies in the band: asin(sin(d/R) / cos(phi)) at the band's poleward edge phi
    (spherical trigonometry); one cell when that circle may hold a pole.  Each step is its own
    column, so no expression repeats another's tree (a repeated tree here grew the generated code
    past the compiler's method limit, and Spark fell back to interpreted evaluation)."""
    delta = max_km / EARTH_RADIUS_KM
    e, x, n = f"{out_n}_e", f"{out_n}_x", f"{out_n}_raw"
    df = df.withColumn(e, F.least(F.greatest(F.abs(F.col(band) * F.lit(band_deg)),
                                             F.abs((F.col(band) + 1) * F.lit(band_deg))), F.lit(90.0)))
    df = df.withColumn(x, F.lit(math.sin(min(delta, math.pi / 2))) / F.cos(F.radians(F.col(e))))
    width = F.degrees(F.asin(F.least(F.col(x), F.lit(1.0)))) * F.lit(1.000001) + F.lit(1e-9)
    df = df.withColumn(n, F.floor(F.lit(360.0) / width).cast("long"))
    # a circle of angular radius delta around a point at |lat| <= edge may hold a pole when
    # delta >= 90 deg - edge: then any longitude difference is possible
    one = (F.lit(delta) >= F.lit(math.pi / 2) - F.radians(F.col(e))) | (F.cos(F.radians(F.col(e))) <= F.lit(0.0)) | \
        (F.col(x) >= F.lit(1.0)) | (F.col(n) < 1)
    return df.withColumn(out_n, F.when(one, F.lit(1).cast("long")).otherwise(F.col(n))).drop(e, x, n)


def _cell(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + F.lit(180.0)) / (F.lit(360.0) / n)).cast("long"), n)


def within_radius(points: DataFrame, refs: DataFrame, max_km: float, keys, ref_keys, lat: str = "latitude",
                  lon: str = "longitude", ref_lat: str = "ref_latitude", ref_lon: str = "ref_longitude") -> DataFrame:
    """Exact radius join for large reference sets, as an equi-join on a 2-D grid.

    Latitude bands are ``max_km`` high (so a match is in the point's band or a neighbour); each
    band is cut into longitude cells at least as wide as any match's longitude difference there
    (see :func:`_with_cells`, wrapping at +-180).  A reference sits in one (band, cell); a point
    asks for the 3 x 3 neighbouring (band, cell) keys, de-duplicated, so each pair meets at most
    once, and the exact distance filter decides.  Only references in neighbouring cells are
    compared -- not a whole band around the globe -- so the candidates per point are bounded by the
    reference density near it."""
    k, rk = _k(keys), _k(ref_keys)
    band_deg = max(max_km / 111.0, 1e-6)  # one degree of latitude on the sphere is 111.19 km
    x = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*k, lat, lon) \
        .withColumn("_b0", F.floor(F.col(lat) / band_deg).cast("long"))
    for i, db in enumerate((-1, 0, 1)):
        x = x.withColumn(f"_b{i + 1}", F.col("_b0") + F.lit(db))
        x = _with_cells(x, f"_b{i + 1}", f"_n{i + 1}", band_deg, max_km)
        x = x.withColumn(f"_c{i + 1}", _cell(F.col(lon), F.col(f"_n{i + 1}")))
    asks = [F.struct(F.col(f"_b{i}").alias("_band"), F.pmod(F.col(f"_c{i}") + F.lit(dc), F.col(f"_n{i}")).alias("_cell"))
            for i in (1, 2, 3) for dc in (-1, 0, 1)]
    pb = x.select(*k, lat, lon, F.inline(F.array_distinct(F.array(*asks))))
    rb = refs.where(F.col(ref_lat).isNotNull() & F.col(ref_lon).isNotNull()).select(*rk, ref_lat, ref_lon) \
        .withColumn("_band", F.floor(F.col(ref_lat) / band_deg).cast("long"))
    rb = _with_cells(rb, "_band", "_rn", band_deg, max_km)
    rb = rb.withColumn("_cell", _cell(F.col(ref_lon), F.col("_rn"))).drop("_rn")
    j = pb.join(rb, ["_band", "_cell"])
    d = haversine_km(lat, lon, ref_lat, ref_lon)
    return j.withColumn("distance_km", d).where(F.col("distance_km") <= F.lit(max_km)).drop("_band", "_cell")


def nearest_ref(points: DataFrame, refs: DataFrame, keys, ref_name: str, lat: str = "latitude",
                lon: str = "longitude", ref_lat: str = "latitude", ref_lon: str = "longitude") -> DataFrame:
    """J2 as a thin table: keys, ``_ref``, ``distance_km`` of the points with coordinates."""
    x = nearest_city(points.select(*_k(keys), lat, lon), refs, lat, lon, ref_name, "_ref", "distance_km", None, ref_lat, ref_lon)
    return x.where(F.col("distance_km").isNotNull()).select(*_k(keys), "_ref", "distance_km")


def active_count(intervals: DataFrame, begin: str, end: str, out: str = "active", grid: str = "month") -> DataFrame:
    """For each month start (or day) from the first begin to the last end, the number of intervals
    covering it (both ends included).  The first month start is on or after the earliest begin."""
    return active_intervals(intervals, begin, end, grid, out=out)


def prefix_match(df: DataFrame, name_col: str, prefixes: DataFrame, prefix_col: str = "prefix") -> DataFrame:
    """Rows whose trimmed name starts with any listed prefix.  A filter: every matching
    input row is kept as often as it occurs, however many prefixes it matches.

    For each distinct prefix length n (a short list: lengths are bounded by the longest name) the
    name's first n characters are equi-joined (left) to the de-duplicated prefixes of that
    length, so a join adds at most one match per row; a row is kept when any join matched.  The
    prefix list is sized once; under the bound every join is a broadcast and the whole filter
    runs without a shuffle, above it each join shuffles on the name head."""
    pfx = materialize(prefixes.select(F.col(prefix_col).alias("_p")).where(F.col("_p").isNotNull()).distinct())
    n, lengths = pfx.agg(F.count(F.lit(1)), F.sort_array(F.collect_set(F.length("_p")))).first()
    name = F.trim(F.col(name_col))
    x = df
    for i, ln in enumerate(lengths):
        side = pfx.where(F.length("_p") == F.lit(ln)).select(F.col("_p").alias(f"_h{i}"), F.lit(True).alias(f"_m{i}"))
        x = attach(x.withColumn(f"_h{i}", F.substring(name, 1, int(ln))), side, f"_h{i}", "left", bound=n)
    hit = F.lit(False)
    for i in range(len(lengths)):
        hit = hit | F.coalesce(F.col(f"_m{i}"), F.lit(False))
    return x.where(hit).select(*df.columns)


def contains_ci(col_name: str, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(F.col(col_name)), F.lit(needle.lower()))


def assert_row_count(df: DataFrame, expected: int) -> DataFrame:
    """Q7: fail the job if the row count differs (checked on the driver with one count)."""
    n = df.count()
    if n != expected:
        raise AssertionError(f"expected {expected} rows, got {n}")
    return df


def in_list(col_name: str, values: Sequence) -> Column:
    return F.col(col_name).isin(list(values))
