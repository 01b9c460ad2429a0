import datetime as dt

import pandas as pd

from stationlab.operators import stats as A
from stationlab.operators import timeseries as TS

K = ["usaf", "wban"]
SCHEMA = "usaf string, wban string, timestamp date, v double"


def days(start, n, step=1):
    d0 = dt.date.fromisoformat(start)
    return [d0 + dt.timedelta(days=i * step) for i in range(n)]


def test_twelve_month_bins_anchor_at_first_month(spark):
    recs = [("1", "A", d, 1.0) for d in days("2000-07-15", 500, 3)]
    df = spark.createDataFrame(recs, SCHEMA)
    b = TS.anchored_month_bins(df, K, "timestamp", 12)
    got = b.groupBy("period_start").count().orderBy("period_start").collect()
    pdf = pd.Series(1.0, index=pd.to_datetime([r[2] for r in recs])).resample("12MS").count()
    pdf = pdf[pdf > 0]
    assert [r.period_start for r in got] == [t.date() for t in pdf.index]
    assert [r["count"] for r in got] == list(pdf.values)


def test_end_anchored_bins_move_with_last_day(spark):
    full = [("1", "A", d, float(i)) for i, d in enumerate(days("2000-01-01", 800))]
    short = full[:-1]
    for data in (full, short):
        df = spark.createDataFrame(data, SCHEMA)
        b = TS.end_anchored_bins(df, K, "timestamp", 365)
        means = {r.bin: r.m for r in b.groupBy("bin").agg({"v": "avg"}).withColumnRenamed("avg(v)", "m").collect()}
        s = pd.Series([r[3] for r in data], index=pd.to_datetime([r[2] for r in data]))
        want = s.resample("365D", origin="end", closed="right", label="right").mean()
        assert sorted(means.values()) == sorted(want.dropna().values)


def test_densify_years_emits_empty_middle_year(spark):
    recs = [("1", "A", dt.date(2000, 5, 1), 1.0), ("1", "A", dt.date(2002, 5, 1), 3.0)]
    df = spark.createDataFrame(recs, SCHEMA)
    a = A.annual_stats(df, K, "timestamp", ["v"], sum_cols=["v"], count_cols=["v"])
    got = {r.period.year: (r.mean_v, r.sum_v, r.count_v) for r in a.collect()}
    assert got == {2000: (1.0, 1.0, 1), 2001: (None, 0.0, 0), 2002: (3.0, 3.0, 1)}


def test_daily_grid_and_sum_filled(spark):
    recs = [("1", "A", dt.date(2000, 1, 1), 1.0), ("1", "A", dt.date(2000, 1, 3), None),
            ("1", "A", dt.date(2000, 1, 4), 2.0)]
    df = spark.createDataFrame(recs, SCHEMA)
    g = {r.day: r.missing for r in TS.daily_grid(df, K, "timestamp", "v").collect()}
    assert g == {dt.date(2000, 1, 1): 0, dt.date(2000, 1, 2): 1, dt.date(2000, 1, 3): 1, dt.date(2000, 1, 4): 0}
    s = {r.day: r.daily_total for r in TS.daily_sum_filled(df, K, "timestamp", "v").collect()}
    assert s[dt.date(2000, 1, 2)] == 0.0 and len(s) == 4


def test_end_window_and_lookup(spark):
    recs = [("1", "A", d, 1.0) for d in days("2000-01-01", 1000)]
    df = spark.createDataFrame(recs, SCHEMA)
    last = TS.end_window(df, K, "timestamp", "last", 1)
    assert last.count() == 365
    first = TS.end_window(df, K, "timestamp", "first", 2)
    assert first.count() == 730
    sparse = spark.createDataFrame([("1", "A", dt.date(2000, 1, 1), 1.0), ("1", "A", dt.date(2000, 1, 10), 1.0)], SCHEMA)
    t = spark.createDataFrame([("1", "A", dt.date(2000, 1, 4))], "usaf string, wban string, target date")
    f = lambda m: TS.lookup_date(sparse, K, "timestamp", t, "target", m).first().found_date
    assert f("bfill") == dt.date(2000, 1, 10)
    assert f("ffill") == dt.date(2000, 1, 1)
    assert f("nearest") == dt.date(2000, 1, 1)


def test_results_do_not_depend_on_partitioning(spark):
    recs = [(str(k), "A", d, float((i * 7 + k) % 13)) for k in range(5) for i, d in enumerate(days("1999-03-01", 900))]
    df = spark.createDataFrame(recs, SCHEMA)
    one = A.annual_stats(df.coalesce(1), K, "timestamp", ["v"]).collect()
    many = A.annual_stats(df.repartition(16), K, "timestamp", ["v"]).collect()
    norm = lambda rs: sorted((r.usaf, r.period, round(r.mean_v, 9), r.max_v, r.min_v, round(r.std_v, 9)) for r in rs)
    assert norm(one) == norm(many)


def test_fill_bins_and_days_add_missing_rows_only(spark):
    import datetime as dt

    per_bin = spark.createDataFrame([("a", 0, 1.0), ("a", 3, 2.0), ("b", 0, 5.0), ("c", None, 9.0)],
                                    "k string, bin int, m double")
    got = sorted((r.k, r.bin, r.m) for r in TS.fill_bins(per_bin, ["k"], "bin").collect())
    assert got == [("a", 0, 1.0), ("a", 1, None), ("a", 2, None), ("a", 3, 2.0), ("b", 0, 5.0)]
    per_day = spark.createDataFrame([("a", dt.date(2000, 2, 27), 1), ("a", dt.date(2000, 3, 1), 2)],
                                    "k string, day date, n int")
    got = [(r.day, r.n) for r in TS.fill_days(per_day, ["k"], "day").orderBy("day").collect()]
    assert got == [(dt.date(2000, 2, 27), 1), (dt.date(2000, 2, 28), None), (dt.date(2000, 2, 29), None),
                   (dt.date(2000, 3, 1), 2)]
