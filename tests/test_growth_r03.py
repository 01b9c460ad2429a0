"""What the growth findings of round 3 asked for: work is spread by its amount and grows with the input."""

import random

from pyspark.sql import functions as F

from stationlab.functions.columns import haversine_km
from stationlab.operators import quadtree, timejoin


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_walk_without_windows_in_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    written, tasks = quadtree.materialize, []

    def spied(df):
        df = written(df)
        tasks.append(df.rdd.getNumPartitions())
        return df

    monkeypatch.setattr(quadtree, "PLACES", 50)
    monkeypatch.setattr(quadtree, "materialize", spied)
    r = random.Random(7)
    refs = [(f"r{i}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(400)] + [("pole", 90.0, 5.0), ("edge", 0.0, 180.0), ("a", 0.0, 180.0)]
    pts = [(r.uniform(-90, 90), r.choice([r.uniform(-180, 180), r.gauss(180, 1)])) for _ in range(600)] + [(-90.0, 0.0), (0.0, -180.0), (90.0, 1.0)]
    p, c = spark.createDataFrame(pts, "lat double, lon double"), spark.createDataFrame(refs, "name string, y double, x double")
    got = quadtree.nearest(p, c, "lat", "lon", "name", "y", "x", leaf=4, depth=8)
    assert "Window" not in plan_of(got)
    assert len(set(pts)) // 50 + 1 in tasks  # whatever few bytes the places are
    brute = p.distinct().crossJoin(c).groupBy("lat", "lon").agg(F.min(F.struct(haversine_km("lat", "lon", "y", "x").alias("km"), "name")).alias("b"))
    want = {(x.lat, x.lon): (x.b["name"], round(x.b["km"], 6)) for x in brute.collect()}
    assert {(x._lat, x._lon): (x._ref, round(x._km, 6)) for x in got.collect()} == want


def test_reach_of_a_cell_holds_all_its_places(spark):
    r = random.Random(8)
    rows = []
    for level in range(9):
        for _ in range(60):
            x, y = r.randrange(1 << level), r.choice([0, (1 << level) - 1, r.randrange(1 << level)])
            for u, v in ((0, 0), (0, 1), (1, 0), (1, 1), (r.random(), r.random())):
                rows.append((level, x, y, (y + u) / (1 << level) * 180 - 90, (x + v) / (1 << level) * 360 - 180))
    df = quadtree._discs(spark.createDataFrame(rows, "_level int, _x long, _y long, a double, o double"))
    assert df.where(haversine_km("a", "o", "_clat", "_clon") > F.col("_reach") + quadtree.SLACK_KM).count() == 0


def test_asof_deals_many_rows_to_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    r = random.Random(9)
    rows = [(r.randint(0, 5), r.randint(0, 900), r.choice([None, 1.5, 2.5])) for _ in range(400)]
    targets = [(r.choice([0, 0, 1, 2, 7, None]), r.choice([None, *range(0, 900, 7)])) for _ in range(300)]
    day = "date_add(date'2020-01-01', d)"
    left = spark.createDataFrame(rows, "k long, d int, v double").selectExpr("k", f"{day} at", "v")
    right = spark.createDataFrame(targets, "k long, d int").selectExpr("k", f"{day} want")
    how = {"nxt": "bfill", "prev": "ffill", "near": "nearest"}
    few = timejoin.asof_lookup(left, right, "k", "at", "want", how, ["v"])
    monkeypatch.setattr(timejoin, "ROWS", 20)
    many = timejoin.asof_lookup(left, right, "k", "at", "want", how, ["v"])
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
    assert many.count() == 300
    told = timejoin.asof_lookup(left, right, "k", "at", "want", how, ["v"], n_rows=800)
    assert sorted(map(str, told.collect())) == sorted(map(str, few.collect())) and ", 41)" in told._jdf.queryExecution().sparkPlan().toString()
    plan = many._jdf.queryExecution().sparkPlan().toString()
    assert plan.count(", 36)") >= 2 and ", 36)" not in few._jdf.queryExecution().sparkPlan().toString()  # 700 rows
