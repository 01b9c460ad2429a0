"""Cases that once gave wrong answers: rounding residue, NULL coordinates, open ends, bin edges, ties, shared names."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from stationlab.operators import cleaning as C
from stationlab.operators import stations as S
from stationlab.operators import stats as A
from stationlab.operators import timeseries as TS
from stationlab.plans import pipelines as P


def test_clean_dataset_keeps_equal_years_of_fractional_readings(spark):
    rows, points = [], []
    for year in range(1968, 1978):
        for i in range(120):
            day = dt.date(year, 1, 1) + dt.timedelta(days=i)
            listed = i % 7 == year % 7
            rows.append(("a", day, 0.1 * (year % 5 + 1) if listed else 0.01))
            if listed:
                points.append(("a", day))
    # the same readings remain in every year once the listed points are left out
    keep = min(sum(1 for r in rows if r[1].year == y and r[2] == 0.01) for y in range(1968, 1978))
    seen, even = {}, []
    for k, d, v in rows:
        if v == 0.01:
            seen[d.year] = seen.get(d.year, 0) + 1
            if seen[d.year] > keep:
                continue
        even.append((k, d, v))
    df = spark.createDataFrame(even, "key string, date date, value double")
    pts = spark.createDataFrame(points, "key string, date date")
    out = C.clean_dataset(df, ["key"], "date", "value", points=pts, z_min_rows=10)
    assert out.count() == len(even)
    listed = {d for _, d in points}
    assert all((r["value"] is None) == (r["date"] in listed) for r in out.collect())


def test_nearest_city_ignores_cities_without_coordinates(spark):
    st = spark.createDataFrame([("a", 40.0, -100.0), ("b", None, None)], "key string, latitude double, longitude double")
    ci = spark.createDataFrame([("none", None, None), ("near", 40.1, -100.0), ("far", 45.0, -100.0)],
                               "city string, latitude double, longitude double")
    for keys in (["key"], None):
        got = {r["key"]: r["nearest_city"] for r in S.nearest_city(st, ci, keys=keys).collect()}
        assert got == {"a": "near", "b": None}
    none = S.nearest_city(st, ci.where("city = 'none'"), keys=["key"])
    assert {r["nearest_city"] for r in none.collect()} == {None}


def test_daily_sum_filled_with_one_end(spark):
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, 3, 4), 1.0), ("a", dt.datetime(2020, 1, 5, 1), 2.0)],
                               "key string, ts timestamp, v double")
    first = TS.daily_sum_filled(df, ["key"], "ts", "v", start="2020-01-01")
    last = TS.daily_sum_filled(df, ["key"], "ts", "v", end="2020-01-06")
    assert sorted((r["day"].day, r["daily_total"]) for r in first.collect()) == [(1, 0.0), (2, 0.0), (3, 1.0), (4, 0.0), (5, 2.0)]
    assert sorted((r["day"].day, r["daily_total"]) for r in last.collect()) == [(3, 1.0), (4, 0.0), (5, 2.0), (6, 0.0)]


def test_histogram_edges_as_numpy(spark):
    values = [i / 10 for i in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["bin"]: (r["bin_lo"], r["count"]) for r in A.histogram(df, "v", 100).collect()}
    want, edges = np.histogram(values, bins=100)
    assert [got[i][1] for i in range(100)] == want.tolist()
    assert np.allclose([got[i][0] for i in range(100)], edges[:-1])
    one = {r["bin"]: r["count"] for r in A.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 4).collect()}
    assert [one[i] for i in range(4)] == np.histogram([2.0] * 3, bins=4)[0].tolist()


def test_row_at_max_takes_the_smallest_tiebreak(spark):
    df = spark.createDataFrame([("g", 5, "b", dt.date(2020, 2, 1)), ("g", 5, "a", dt.date(2020, 3, 1)), ("g", None, "0", dt.date(2020, 1, 1)),
                                ("g", 4, "A", dt.date(2020, 1, 1))], "k string, v int, name string, day date")
    assert A.row_at_max(df, "v", ["k"], ["name"]).first()["name"] == "a"
    assert A.row_at_max(df, "v", ["k"], ["day"]).first()["name"] == "b"
    assert A.row_at_max(df, "day", ["k"], ["name"]).first()["name"] == "a"


def test_annual_precip_keeps_stations_that_share_a_name(spark):
    key = P.KEY[0]
    rows = [(k, dt.date(2001, 1, 1) + dt.timedelta(days=i), v) for k, v in (("s1", 0.1), ("s2", 0.2), ("s3", 0.3)) for i in range(365)]
    extra = ", ".join(f"{c} string" for c in P.KEY)
    panel = spark.createDataFrame([(*[k] * len(P.KEY), d, v) for k, d, v in rows], f"{extra}, {P.DATE} date, {P.PRECIP} double")
    meta = spark.createDataFrame([(*[k] * len(P.KEY), n) for k, n in (("s1", "X"), ("s2", "X"), ("s3", "Y"))], f"{extra}, name string")
    out = P.clean_annual_precip(panel, meta)
    assert len(out.columns) == 4 and "Y" in out.columns and key
    row = out.first().asDict()
    assert sorted(round(v, 1) for c, v in row.items() if c != "year") == [36.5, 73.0, 109.5]
    assert out.select(F.col("year")).first()[0] == 2001
