import datetime as dt

import numpy as np
import pandas as pd

from stationlab.operators import cleaning as C

K = ["usaf", "wban"]
SCHEMA = "usaf string, wban string, timestamp date, v double"


def days(start, n):
    d0 = dt.date.fromisoformat(start)
    return [d0 + dt.timedelta(days=i) for i in range(n)]


def frame(spark, recs):
    return spark.createDataFrame(recs, SCHEMA)


def test_null_at_points_ignores_repeats_and_absent(spark):
    df = frame(spark, [("1", "A", d, 1.0) for d in days("2000-01-01", 5)])
    pts = spark.createDataFrame([("1", "A", dt.date(2000, 1, 2)), ("1", "A", dt.date(2000, 1, 2)),
                                 ("9", "Z", dt.date(2000, 1, 3))], "usaf string, wban string, timestamp date")
    out = C.null_at_points(df, pts, K, "timestamp", "v")
    assert out.count() == 5
    assert sorted(r.timestamp for r in out.where("v is null").collect()) == [dt.date(2000, 1, 2)]


def test_null_at_years(spark):
    df = frame(spark, [("1", "A", d, 1.0) for d in days("1999-12-30", 5)])
    yrs = spark.createDataFrame([("1", "A", 2000), ("1", "A", 2000)], "usaf string, wban string, year int")
    out = C.null_at_years(df, yrs, K, "timestamp", "v")
    assert out.count() == 5 and out.where("v is null").count() == 3


def test_implausible_years_thresholds(spark):
    recs = []
    # key 1: 329 values summing to 0.99 -> flagged; key 2: 328 values -> not; key 3: 329 values, 1.0 -> not
    for key, n, total in (("1", 329, 0.99), ("2", 328, 0.5), ("3", 329, 1.0)):
        vals = [total] + [0.0] * (n - 1)
        recs += [(key, "A", d, v) for d, v in zip(days("2001-01-01", n), vals)]
    out = C.implausible_years(frame(spark, recs), K, "timestamp", "v")
    assert [(r.usaf, r.year) for r in out.collect()] == [("1", 2001)]


def test_exclusions_judged_on_input(spark):
    # the year total is only low after a listed point is nulled: it must not be flagged
    n = 340
    vals = [0.5] + [0.0] * (n - 1)
    recs = [("1", "A", d, v) for d, v in zip(days("2001-01-01", n), vals)]
    df = frame(spark, recs)
    pts = spark.createDataFrame([("1", "A", dt.date(2001, 1, 1))], "usaf string, wban string, timestamp date")
    assert C.implausible_years(df, K, "timestamp", "v").count() == 1   # 0.5 < 1.0 -> flagged as is
    recs2 = [("1", "A", d, v) for d, v in zip(days("2001-01-01", n), [1.5] + [0.0] * (n - 1))]
    out = C.null_excluded(frame(spark, recs2), K, "timestamp", "v", points=pts)
    # input total 1.5 is plausible; only the listed point is nulled
    assert out.where("v is null").count() == 1


def test_gap_keys_cases(spark):
    recs = []
    for y in range(1970, 1977):          # rows in 1970-76 but not 1977 -> flagged
        recs.append(("1", "A", dt.date(y, 6, 1), 1.0))
    for y in range(1970, 1978):          # all eight years -> not flagged
        recs.append(("2", "A", dt.date(y, 6, 1), None if y == 1972 else 1.0))  # all-null year still counts
    recs.append(("3", "A", dt.date(1990, 1, 1), 1.0))   # no rows in span -> not flagged
    out = C.gap_keys(frame(spark, recs), K, "timestamp", 1970, 1977)
    assert [r.usaf for r in out.collect()] == ["1"]
    kept = C.remove_before_if_gap(frame(spark, recs + [("1", "A", dt.date(1980, 1, 1), 1.0)]), K, "timestamp")
    assert sorted(r.timestamp.year for r in kept.where("usaf = '1'").collect()) == [1973, 1974, 1975, 1976, 1980]


def _pandas_z(series: pd.Series):
    span = series["1973-01-01":"1973-05-31"]
    if len(span) < 100:
        return np.nan
    rest = series["1974":]
    rest = rest[rest.index.month <= 5]
    annual = rest.resample("YS").sum()
    sd = annual.std()
    if sd == 0:
        return np.nan
    return (span.sum() - annual.mean()) / sd


def test_anomaly_zscore_matches_pandas_with_gap_years(spark):
    rng = np.random.default_rng(5)
    recs = []
    cases = {"1": (1973, 1980, {1976}), "2": (1973, 1985, set()), "3": (1973, 1979, {1975, 1977})}
    for key, (y0, y1, missing) in cases.items():
        for y in range(y0, y1 + 1):
            if y in missing:
                continue
            for d in days(f"{y}-01-01", 151):
                recs.append((key, "A", d, float(rng.gamma(0.5, 0.2)) if rng.random() > 0.1 else None))
    df = frame(spark, recs)
    got = {r.usaf: r.zscore for r in C.anomaly_zscore(df, K, "timestamp", "v").collect()}
    pdf = pd.DataFrame(recs, columns=["usaf", "wban", "timestamp", "v"])
    pdf["timestamp"] = pd.to_datetime(pdf["timestamp"])
    for key, g in pdf.groupby("usaf"):
        want = _pandas_z(g.set_index("timestamp")["v"])
        assert np.isclose(got[key], want, rtol=1e-10), (key, got[key], want)


def test_anomaly_zscore_guards(spark):
    recs = [("1", "A", d, 1.0) for d in days("1973-01-01", 99)]            # 99 rows -> NULL
    recs += [("2", "A", d, 1.0) for d in days("1973-01-01", 100)]          # 100 rows, constant later sums
    for y in (1974, 1975):
        recs += [("2", "A", d, 1.0) for d in days(f"{y}-01-01", 10)]
    recs += [("3", "A", d, 1.0) for d in days("1973-01-01", 100)]          # one later year -> NULL
    recs += [("3", "A", d, 1.0) for d in days("1974-01-01", 10)]
    z = {r.usaf: r.zscore for r in C.anomaly_zscore(frame(spark, recs), K, "timestamp", "v").collect()}
    assert z == {"1": None, "2": None, "3": None}


def test_remove_anomalous_span_threshold_is_strict(spark):
    # construct z exactly 5: later sums 0 and 2 -> mean 1, std sqrt(2); span sum 1 + 5*sqrt(2)
    span_sum = float(1 + 5 * np.sqrt(2))
    recs = [("1", "A", d, span_sum if i == 0 else 0.0) for i, d in enumerate(days("1973-01-01", 100))]
    recs += [("1", "A", dt.date(1974, 1, 1), 0.0), ("1", "A", dt.date(1975, 1, 1), 2.0)]
    df = frame(spark, recs)
    z = C.anomaly_zscore(df, K, "timestamp", "v").first().zscore
    assert abs(z - 5.0) < 1e-9
    kept = C.remove_anomalous_span(df, K, "timestamp", "v", threshold=5.0 + 1e-6)
    assert kept.count() == len(recs)
    dropped = C.remove_anomalous_span(df, K, "timestamp", "v", threshold=4.0)
    assert dropped.count() == 2


def test_ratio_flags(spark):
    recs = [("1", "A", d, 0.1) for d in days("1980-01-01", 30)] + [("1", "A", dt.date(1980, 3, 1), 10.0),
                                                                   ("1", "A", dt.date(1973, 3, 1), 50.0)]
    out = C.ratio_flags(frame(spark, recs), K, "timestamp", "v", threshold=20.0)
    assert [r.timestamp for r in out.collect()] == [dt.date(1980, 3, 1)]


def test_drop_keys_and_keep_keys(spark):
    df = frame(spark, [("1", "A", dt.date(2000, 1, 1), 1.0), ("2", "A", dt.date(2000, 1, 1), 1.0)])
    ks = spark.createDataFrame([("2", "A"), ("2", "A"), ("7", "Q")], "usaf string, wban string")
    assert [r.usaf for r in C.drop_keys(df, ks, K).collect()] == ["1"]
    assert [r.usaf for r in C.keep_keys(df, ks, K).collect()] == ["2"]
    assert [r.usaf for r in C.missing_keys(df, ks, K).collect()] == ["7"]


def test_two_pass_clean_equals_stepwise(spark):
    rng = np.random.default_rng(11)
    recs = []
    for key in range(6):
        for y in range(1970, 1982):
            if key == 1 and y == 1972:
                continue                                     # gap year
            if key == 2 and y == 1973:
                months = range(1, 6)                         # 1973 only Jan-May: can become a gap after removal
            else:
                months = range(1, 13)
            for m in months:
                for dd in (1, 8, 15, 22):
                    val = float(rng.gamma(0.4, 0.3))
                    if y == 1973 and m <= 5 and key in (2, 3):
                        val += 3.0                           # anomalous early span
                    if key == 4 and y == 1975:
                        val = 0.0                            # implausibly dry year (judged with low thresholds)
                    recs.append((str(key), "A", dt.date(y, m, dd), val))
    df = frame(spark, recs)
    pts = spark.createDataFrame([("0", "A", dt.date(1973, 2, 8)), ("0", "A", dt.date(1973, 2, 8)),
                                 ("3", "A", dt.date(1974, 3, 1))], "usaf string, wban string, timestamp date")
    yrs = spark.createDataFrame([("5", "A", 1974)], "usaf string, wban string, year int")
    dropped = spark.createDataFrame([("4", "B"), ("9", "A")], "usaf string, wban string")
    kw = dict(min_count=40, max_sum=0.5)
    step = C.null_excluded(df, K, "timestamp", "v", points=pts, years=yrs, **kw)
    step = C.remove_anomalous_span(step, K, "timestamp", "v", 1973, 5, threshold=1.5, min_rows=15)
    step = C.drop_keys(step, dropped, K)
    step = C.remove_before_if_gap(step, K, "timestamp", "1973-01-01", 1970, 1977)
    two = C.clean_dataset(df, K, "timestamp", "v", points=pts, years=yrs, dropped=dropped, z_threshold=1.5,
                          z_min_rows=15, **kw)
    a = sorted((r.usaf, r.timestamp, None if r.v is None else round(r.v, 12)) for r in step.collect())
    b = sorted((r.usaf, r.timestamp, None if r.v is None else round(r.v, 12)) for r in two.collect())
    assert a == b
    removed = {r.usaf for r in df.subtract(step.select(df.columns)).collect()}
    assert {"1", "2", "3"} <= removed                       # gap, gap-after-removal and anomalous keys lost rows
