"""Nearest reference point over a quad-tree of adaptive cells (J2), for reference tables of any size.

The sphere's longitude x latitude rectangle is split in four again and again; a cell with at most
``leaf`` reference points is a leaf, so cells are small where references are dense and wide where they
are sparse.  All counts come from one aggregation.  A point first takes the distance to the nearest reference of its own
leaf, or to a representative of a cell around it, so the bound is that of a real reference.  Then points
walk down the tree level by level: of the cells a point holds, those whose middle is farther than the
bound and the cell's own reach are dropped, and only the rest are opened.  The leaves that remain after a
last look at their edges are joined to their references and the exact minimum is taken.

The bounds hold on the sphere (also over the poles and across +-180 degrees), and a slack far above
rounding keeps ties.  A point holds a handful of cells at a time, whatever the number of references; a
level is a join and a filter, without a sort or a shuffle.  The points are dealt to as many tasks as their number asks for, because a
point's few bytes tell nothing of its work.  A join on cells is a broadcast only while the tree's counted size allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EARTH_RADIUS_KM, haversine_km
from ..plans.physical import materialize, small_side

LEAF = 32
DEPTH = 16
# km by which a cell may be farther than the best reference and is still opened: rounding only
SLACK_KM = 0.001
# levels walked between two checkpoints
STRIDE = 8
# places walked by one task
PLACES = 4096


def _valid(lat: Column, lon: Column) -> Column:
    """Both coordinates are there, are numbers and lie on the sphere."""
    return F.coalesce((F.abs(lat) <= 90.0) & (F.abs(lon) <= 100_000.0), F.lit(False))


def _cell(lat: Column, lon: Column, depth: int) -> tuple[Column, Column]:
    """Column and row of the cell of the finest level (longitudes wrap, the upper edges belong to the last cell)."""
    n = 1 << depth
    x = F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n).cast("long")
    y = F.floor((lat + 90.0) / 180.0 * n).cast("long")
    return F.least(x, F.lit(n - 1)), F.least(y, F.lit(n - 1))


def least_km(df: DataFrame, out: str, lat: str, lon: str, level: str, x: str, y: str) -> DataFrame:
    """Adds the least distance from a point to cell (level, x, y).

    Above or below the cell's longitudes it is the latitude difference.  Beside them the nearest point
    lies on one of the two edge meridians; along a meridian the distance has one least point, at
    atan2(sin a, cos a cos d) for latitude a and longitude difference d, or at an end of the edge."""
    n = F.pow(F.lit(2.0), level)
    df = df.withColumns({"_s": F.col(y) / n * 180.0 - 90.0, "_n": (F.col(y) + 1) / n * 180.0 - 90.0,
                         "_w": F.col(x) / n * 360.0 - 180.0, "_e": (F.col(x) + 1) / n * 360.0 - 180.0,
                         "_l": F.pmod(F.col(lon) + 180.0, F.lit(360.0)) - 180.0})
    edges = []
    for name, edge in (("_dw", "_w"), ("_de", "_e")):
        turn = F.cos(F.radians(lat)) * F.cos(F.radians(F.col(edge) - F.col("_l")))
        df = df.withColumn("_f", F.degrees(F.atan2(F.sin(F.radians(lat)), turn)))
        df = df.withColumn("_f", F.least(F.greatest("_f", "_s"), F.col("_n")))
        df = df.withColumn(name, F.least(*[haversine_km(lat, "_l", at, edge) for at in ("_s", "_n", "_f")]))
        edges.append(name)
    inside = F.radians(F.greatest(F.col("_s") - F.col(lat), F.col(lat) - F.col("_n"), F.lit(0.0))) * EARTH_RADIUS_KM
    df = df.withColumn(out, F.when(F.col("_l").between(F.col("_w"), F.col("_e")), inside).otherwise(F.least(*edges)))
    return df.drop("_s", "_n", "_w", "_e", "_l", "_f", *edges)


def build(refs: DataFrame, name: str, lat: str, lon: str, leaf: int = LEAF, depth: int = DEPTH) -> tuple[DataFrame, DataFrame, int]:
    """The tree over ``refs``: its occupied cells (_level, _x, _y, _open, and a representative reference
    _rlat, _rlon), its references with their leaf (_level, _x, _y, _name, _rlat, _rlon), and its height.

    References without valid coordinates are left out; of references at one place the smallest name
    stays.  A cell of the finest level is a leaf however many references it holds."""
    place = refs.select(F.col(f"`{name}`").cast("string").alias("_name"), F.col(f"`{lat}`").cast("double").alias("_rlat"),
                        F.col(f"`{lon}`").cast("double").alias("_rlon")).where(_valid(F.col("_rlat"), F.col("_rlon")))
    place = place.groupBy("_rlat", "_rlon").agg(F.min("_name").alias("_name"))
    x, y = _cell(F.col("_rlat"), F.col("_rlon"), depth)
    place = materialize(place.withColumns({"_fx": x, "_fy": y}))

    def level(n: int) -> Column:
        return F.struct(F.lit(n).alias("_level"), F.shiftright("_fx", depth - n).alias("_x"), F.shiftright("_fy", depth - n).alias("_y"))

    every = F.inline(F.array(*[level(n) for n in range(depth + 1)]))
    fine = place.groupBy("_fx", "_fy").agg(F.count(F.lit(1)).alias("_n"), F.min("_rlat").alias("_rlat"), F.min_by("_rlon", F.struct("_rlat", "_rlon")).alias("_rlon"))
    cells = fine.select("_n", F.struct("_rlat", "_rlon").alias("_at"), every) \
        .groupBy("_level", "_x", "_y").agg(F.sum("_n").alias("_n"), F.min("_at").alias("_at"))
    cells = materialize(cells.select("_level", "_x", "_y", ((F.col("_n") > leaf) & (F.col("_level") < depth)).alias("_open"),
                                     F.col("_at._rlat").alias("_rlat"), F.col("_at._rlon").alias("_rlon")))
    # a cell belongs to the tree if the cell above it is open; the root always does
    above = cells.where("_open").select((F.col("_level") + 1).alias("_level"), F.col("_x").alias("_px"), F.col("_y").alias("_py"))
    below = cells.withColumns({"_px": F.shiftright("_x", 1), "_py": F.shiftright("_y", 1)})
    tree = below.where("_level = 0").unionByName(below.join(above, ["_level", "_px", "_py"], "left_semi")).drop("_px", "_py")
    tree = materialize(tree)
    height = tree.agg(F.max("_level")).first()[0] or 0
    leaves = small_side(tree.where("not _open").select("_level", "_x", "_y"), persist=False)
    held = place.select("_name", "_rlat", "_rlon", every).join(leaves, ["_level", "_x", "_y"])
    return tree, materialize(held), height


def _discs(tree: DataFrame) -> DataFrame:
    """The cells with their middle (_clat, _clon) and ``_reach``: no place of a cell is farther from it.

    Within half a cell's height and width of the middle, and not nearer to the equator than the cell is,
    the haversine is largest with all three at their limits."""
    n = F.pow(F.lit(2.0), "_level")
    tree = tree.withColumns({"_clat": (F.col("_y") + 0.5) / n * 180.0 - 90.0, "_clon": (F.col("_x") + 0.5) / n * 360.0 - 180.0})
    low = F.greatest(F.abs("_clat") - F.lit(90.0) / n, F.lit(0.0))
    up, side = F.sin(F.radians(F.lit(45.0) / n)), F.sin(F.radians(F.lit(90.0) / n))
    h = up * up + F.cos(F.radians("_clat")) * F.cos(F.radians(low)) * side * side
    return tree.withColumn("_reach", F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def nearest(points: DataFrame, refs: DataFrame, lat: str, lon: str, ref_name: str, ref_lat: str, ref_lon: str,
            leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """The nearest reference of each distinct valid place of ``points``: _lat, _lon, _ref, _km.  Ties go to
    the smaller name."""
    tree, held, height = build(refs, ref_name, ref_lat, ref_lon, leaf, depth)
    cell = ["_level", "_x", "_y"]
    cells, held = small_side(_discs(tree), persist=False), small_side(held, persist=False)
    place = points.select(F.col(f"`{lat}`").cast("double").alias("_lat"), F.col(f"`{lon}`").cast("double").alias("_lon"))
    place = materialize(place.where(_valid(F.col("_lat"), F.col("_lon"))).distinct())
    tasks = place.count() // PLACES + 1
    # a first bound: the references of the place's own leaf, or the representatives of the cells around it
    x, y = _cell(F.col("_lat"), F.col("_lon"), depth)
    own = place.repartition(tasks, "_lat", "_lon").withColumns({"_fx": x, "_fy": y})
    own = own.select("_lat", "_lon", F.inline(F.array(*[
        F.struct(F.lit(n).alias("_level"), F.shiftright("_fx", depth - n).alias("_x"), F.shiftright("_fy", depth - n).alias("_y"))
        for n in range(height + 1)]))).join(cells, cell)
    km = haversine_km("_lat", "_lon", "_rlat", "_rlon")
    best = own.select("_lat", "_lon", km.alias("_best")).unionByName(
        own.where("not _open").select("_lat", "_lon", *cell).join(held, cell).select("_lat", "_lon", km.alias("_best")))
    best = best.groupBy("_lat", "_lon").agg(F.min("_best").alias("_best"))
    front = materialize(best.repartition(tasks, "_lat", "_lon")).withColumns(
        {"_level": F.lit(0), "_x": F.lit(0).cast("long"), "_y": F.lit(0).cast("long"), "_open": F.lit(height > 0)})
    for step in range(height):
        def child(dx: int, dy: int) -> Column:
            return F.struct((F.col("_level") + 1).alias("_level"), (F.col("_x") * 2 + dx).alias("_x"), (F.col("_y") * 2 + dy).alias("_y"))

        four = F.array(*[child(dx, dy) for dx in (0, 1) for dy in (0, 1)])
        stay = F.array(F.struct(*cell))
        front = front.select("_lat", "_lon", "_best", F.inline(F.when(F.col("_open"), four).otherwise(stay))).join(cells, cell)
        front = front.where(haversine_km("_lat", "_lon", "_clat", "_clon") <= F.col("_best") + F.col("_reach") + SLACK_KM) \
            .select("_lat", "_lon", "_best", *cell, "_open")
        if step % STRIDE == STRIDE - 1:
            front = materialize(front)
    # the cells' edges part what their middles did not
    last = least_km(front.select("_lat", "_lon", "_best", *cell), "_least", "_lat", "_lon", "_level", "_x", "_y")
    last = last.where(F.col("_least") <= F.col("_best") + SLACK_KM).drop("_least")
    last = last.join(held, cell).withColumn("_km", km).where(F.col("_km") <= F.col("_best"))
    return last.groupBy("_lat", "_lon").agg(F.min(F.struct("_km", F.col("_name").alias("_ref"))).alias("_b")) \
        .select("_lat", "_lon", F.col("_b._ref").alias("_ref"), F.col("_b._km").alias("_km"))
