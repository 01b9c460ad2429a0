import datetime as dt

from pyspark.sql import functions as F

from stationlab.operators import stations as ST
from stationlab.functions.columns import haversine_km


def test_nearest_city_ties_nulls_and_inclusive_radius(spark):
    cities = spark.createDataFrame([("Beta", 0.0, 1.0), ("Alpha", 0.0, -1.0), ("Far", 40.0, 40.0)],
                                   "city string, latitude double, longitude double")
    st = spark.createDataFrame([("1", "A", 0.0, 0.0), ("2", "A", None, None), ("3", "A", 0.0, 0.9)],
                               "usaf string, wban string, latitude double, longitude double")
    for keys in (None, ["usaf", "wban"]):
        got = {r.usaf: (r.nearest_city, r.distance_km) for r in ST.nearest_city(st, cities, keys=keys).collect()}
        assert got["1"][0] == "Alpha"          # equally near two cities -> first by name
        assert got["2"] == (None, None)
        assert got["3"][0] == "Beta"
    d = got["3"][1]
    flagged = ST.near_and_long(ST.nearest_city(st, cities, keys=["usaf", "wban"]).withColumn("duration_years", F.lit(20.0)),
                               d, 10.0, inclusive=True)
    assert "3" in [r.usaf for r in flagged.collect()]
    strict = ST.near_and_long(ST.nearest_city(st, cities, keys=["usaf", "wban"]).withColumn("duration_years", F.lit(20.0)),
                              d, 10.0, inclusive=False)
    assert "3" not in [r.usaf for r in strict.collect()]


def test_within_radius_equals_brute_force(spark):
    pts = spark.range(300).select(F.col("id").alias("pid"), (30 + (F.col("id") * 37 % 100) / 10.0).alias("latitude"),
                                  (-120 + (F.col("id") * 53 % 100) / 10.0).alias("longitude"))
    refs = spark.range(40).select(F.col("id").alias("rid"), (30 + (F.col("id") * 17 % 100) / 10.0).alias("ref_latitude"),
                                  (-120 + (F.col("id") * 29 % 100) / 10.0).alias("ref_longitude"))
    grid = {(r.pid, r.rid) for r in ST.within_radius(pts, refs, 150.0, ["pid"], ["rid"]).collect()}
    brute = pts.crossJoin(refs).where(haversine_km("latitude", "longitude", "ref_latitude", "ref_longitude") <= 150.0)
    assert grid == {(r.pid, r.rid) for r in brute.collect()}


def test_active_count_month_starts(spark):
    iv = spark.createDataFrame([(dt.date(2000, 1, 15), dt.date(2000, 4, 1)), (dt.date(2000, 2, 1), dt.date(2000, 2, 20))],
                               "b date, e date")
    got = {r.month: r.active for r in ST.active_count(iv, "b", "e").collect()}
    # first month start on/after the earliest begin is Feb 1
    assert got == {dt.date(2000, 2, 1): 2, dt.date(2000, 3, 1): 1, dt.date(2000, 4, 1): 1}


def test_prefix_match(spark):
    df = spark.createDataFrame([(1, "  CHEYENNE AP "), (2, "CHEY"), (3, "BOISE"), (4, "CHEYENNE WFO")], "id int, name string")
    pre = spark.createDataFrame([("CHEYENNE",), ("CHEYENNE A",), ("BOI",)], "prefix string")
    assert sorted(r.id for r in ST.prefix_match(df, "name", pre).collect()) == [1, 3, 4]
    twice = df.unionByName(df.where("id = 1"))               # a repeated input row is kept twice,
    assert sorted(r.id for r in ST.prefix_match(twice, "name", pre).collect()) == [1, 1, 3, 4]  # once per copy
    none = spark.createDataFrame([], "prefix string")
    assert ST.prefix_match(df, "name", none).count() == 0


def test_within_radius_grid_exact_worldwide(spark):
    import numpy as np

    rng = np.random.default_rng(8)

    def pts(n, prefix):
        lat = np.concatenate([rng.uniform(-90, 90, n), rng.uniform(84, 90, n // 4), rng.uniform(-90, -84, n // 4),
                              rng.uniform(-60, 60, n // 4)])
        lon = np.concatenate([rng.uniform(-180, 180, n), rng.uniform(-180, 180, n // 2),
                              rng.choice([-1, 1], n // 4) * rng.uniform(179.0, 180.0, n // 4)])
        return [(f"{prefix}{i}", float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))]

    p, r = pts(400, "p"), pts(300, "r")
    for km in (40.0, 300.0, 2500.0):
        pdf = spark.createDataFrame(p, "pid string, latitude double, longitude double")
        rdf = spark.createDataFrame(r, "rid string, ref_latitude double, ref_longitude double")
        got = [(x.pid, x.rid) for x in ST.within_radius(pdf, rdf, km, ["pid"], ["rid"]).collect()]
        assert len(got) == len(set(got))                        # each pair meets once
        la1, lo1 = np.radians([a for _, a, _ in p])[:, None], np.radians([o for _, _, o in p])[:, None]
        la2, lo2 = np.radians([a for _, a, _ in r])[None, :], np.radians([o for _, _, o in r])[None, :]
        h = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin((lo2 - lo1) / 2) ** 2
        dist = 2 * 6371.0 * np.arcsin(np.sqrt(h))
        want = {(p[i][0], r[j][0]) for i, j in zip(*np.nonzero(dist <= km))}
        # pairs within a micrometre of the radius may differ by rounding between numpy and Spark
        edge = {(p[i][0], r[j][0]) for i, j in zip(*np.nonzero(np.abs(dist - km) < 1e-9))}
        assert set(got) ^ want <= edge, (km, sorted(set(got) ^ want)[:5])
        assert len(want) > 0


def _np_dist(p, r):
    import numpy as np

    la1, lo1 = np.radians([a for _, a, _ in p])[:, None], np.radians([o for _, _, o in p])[:, None]
    la2, lo2 = np.radians([a for _, a, _ in r])[None, :], np.radians([o for _, _, o in r])[None, :]
    h = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def test_within_radius_beyond_a_quarter_circumference(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    p = [(f"p{i}", float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150)))]
    r = [(f"r{i}", float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)))]
    pdf = spark.createDataFrame(p, "pid string, latitude double, longitude double")
    rdf = spark.createDataFrame(r, "rid string, ref_latitude double, ref_longitude double")
    for km in (12000.0, 19000.0):
        got = {(x.pid, x.rid) for x in ST.within_radius(pdf, rdf, km, ["pid"], ["rid"]).collect()}
        d = _np_dist(p, r)
        want = {(p[i][0], r[j][0]) for i, j in zip(*np.nonzero(d <= km))}
        edge = {(p[i][0], r[j][0]) for i, j in zip(*np.nonzero(np.abs(d - km) < 1e-9))}
        assert got ^ want <= edge


def test_nearest_ref_exact_with_sparse_and_dense_refs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    p = [(f"p{i}", float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 200), rng.uniform(-180, 180, 200)))]
    p.append(("pnull", None, 5.0))
    # a dense cluster in Europe and three lone references far apart: rounds of every size are used
    r = [(f"c{i}", float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(45, 55, 80), rng.uniform(0, 15, 80)))]
    r += [("lone_a", -70.0, 120.0), ("lone_b", 10.0, -150.0), ("lone_c", -20.0, -60.0)]
    pdf = spark.createDataFrame(p, "pid string, latitude double, longitude double")
    rdf = spark.createDataFrame(r, "city string, latitude double, longitude double")
    got = {x.pid: (x._ref, x.distance_km) for x in ST.nearest_ref(pdf, rdf, ["pid"], "city").collect()}
    pp = [t for t in p if t[1] is not None]
    d = _np_dist(pp, r)
    assert set(got) == {t[0] for t in pp}
    for i, t in enumerate(pp):
        j = int(np.argmin(d[i]))
        assert np.isclose(got[t[0]][1], d[i, j]) and (got[t[0]][0] == r[j][0] or np.isclose(d[i, j], d[i]).sum() > 1)


def _nearest_brute(p, r):
    """(name, km) of the nearest reference by the library's own distance formula; ties to the smaller name."""
    out = {}
    for pid, a, o in p:
        if a is None or o is None:
            out[pid] = None
            continue
        d = _np_dist([(pid, a, o)], r)[0]
        out[pid] = (d.min(), {r[j][0] for j in range(len(r)) if d[j] <= d.min() + 1e-9})
    return out


def _check_nearest(spark, p, r, **tree):
    pdf = spark.createDataFrame(p, "pid string, lat double, lon double")
    rdf = spark.createDataFrame(r, "name string, y double, x double")
    from stationlab.operators.quadtree import nearest
    best = nearest(pdf, rdf, "lat", "lon", "name", "y", "x", **tree)
    got = {(x._lat, x._lon): (x._ref, x._km) for x in best.collect()}
    valid = [x for x in r if x[1] is not None and x[2] is not None]
    for pid, want in _nearest_brute(p, valid).items():
        a, o = next((a, o) for i, a, o in p if i == pid)
        if want is None:
            assert (a, o) not in got
        else:
            ref, km = got[(a, o)]
            assert abs(km - want[0]) < 1e-6 and ref in want[1], (pid, a, o, ref, km, want)


def test_quadtree_everywhere(spark):
    import numpy as np

    rng = np.random.default_rng(14)
    p = [(f"p{i}", float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 250), rng.uniform(-180, 180, 250)))]
    p += [("north", 90.0, 0.0), ("south", -90.0, 77.0), ("east", 0.0, 180.0), ("west", 0.0, -180.0), ("wrapped", 10.0, 190.0),
          ("null", None, 1.0), ("null2", 1.0, None), ("near pole", 89.99, -135.0), ("corner", 45.0, 90.0)]
    # dense clusters (a third of all at a few places), lone references, both sides of the antimeridian, poles, repeats
    r = [(f"c{i:03d}", float(a), float(o)) for i, (a, o) in enumerate(zip(rng.normal(50, 0.01, 300), rng.normal(8, 0.01, 300)))]
    r += [(f"w{i:03d}", float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-80, 80, 200), rng.uniform(-180, 180, 200)))]
    r += [("pole", 90.0, 12.0), ("fiji", -17.0, 179.99), ("samoa", -14.0, -179.9), ("same b", 50.0, 8.0), ("same a", 50.0, 8.0),
          ("broken", None, 8.0), ("broken2", 8.0, None), ("far", -89.5, 33.0)]
    _check_nearest(spark, p, r, leaf=4, depth=10)
    _check_nearest(spark, p, r)


def test_quadtree_with_few_references_and_none(spark):
    p = [("a", 40.0, -100.0), ("b", -33.0, 151.0), ("c", None, None)]
    _check_nearest(spark, p, [("one", 10.0, 10.0)])
    _check_nearest(spark, p, [("one", 10.0, 10.0), ("two", -10.0, 170.0), ("three", 60.0, -170.0)], leaf=1, depth=6)
    empty = spark.createDataFrame([], "city string, latitude double, longitude double")
    pts = spark.createDataFrame(p, "pid string, latitude double, longitude double")
    assert {(x.nearest_city, x.distance_km) for x in ST.nearest_city(pts, empty).collect()} == {(None, None)}
    assert ST.nearest_city(pts.where("false"), empty).count() == 0


def test_cell_bound_is_never_above_a_real_distance(spark):
    import numpy as np

    from stationlab.operators.quadtree import least_km

    rng = np.random.default_rng(2)
    rows = []
    for _ in range(3000):
        level = int(rng.integers(0, 7))
        x, y = int(rng.integers(0, 1 << level)), int(rng.integers(0, 1 << level))
        u, v = (0.0, 0.0) if rng.random() < 0.2 else rng.random(2)
        rows.append((float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), level, x, y,
                     float((y + v) / (1 << level) * 180 - 90), float((x + u) / (1 << level) * 360 - 180)))
    df = spark.createDataFrame(rows, "lat double, lon double, l int, x long, y long, qa double, qo double")
    df = least_km(df, "least", "lat", "lon", "l", "x", "y").withColumn("real", haversine_km("lat", "lon", "qa", "qo"))
    assert df.where("least > real + 1e-4").count() == 0
    assert df.where("least > 0").count() > 1000


def test_nearest_city_takes_other_column_names_and_repeated_rows(spark):
    st = spark.createDataFrame([(1, 40.0, -100.0), (1, 40.0, -100.0), (2, 47.0, -110.0), (3, float("nan"), 1.0), (4, 91.0, 1.0)], "k int, a double, o double")
    ci = spark.createDataFrame([("x", 41.0, -101.0), ("y", 47.5, -111.0)], "town string, north double, east double")
    got = ST.nearest_city(st, ci, "a", "o", "town", city_lat="north", city_lon="east")
    assert got.columns == ["k", "a", "o", "nearest_city", "distance_km"]
    assert sorted((r.k, r.nearest_city) for r in got.collect() if r.k < 3) == [(1, "x"), (1, "x"), (2, "y")]
    assert all(r.nearest_city is None for r in got.collect() if r.k >= 3)
    near = ST.city_members(st, ci, ["k"], 300.0, "a", "o", "town", "north", "east")
    assert sorted((r.town, r.k) for r in near.collect()) == [("x", 1), ("x", 1), ("y", 2)]


def test_nearest_plan_has_no_nested_loop(spark):
    st = spark.createDataFrame([(1, 40.0, -100.0)], "k int, latitude double, longitude double")
    ci = spark.range(500).selectExpr("concat('c', id) AS city", "double(id % 170) / 2 - 40 AS latitude", "double(id * 37 % 360) - 180 AS longitude")
    plan = ST.nearest_city(st, ci)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
