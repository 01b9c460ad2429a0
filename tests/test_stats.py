import numpy as np

from pyspark.sql import functions as F

from stationlab.operators import quality as Q
from stationlab.operators import stats as A


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 0.5, 1.0, 9.99, 10.0, 10.5, -1.0, None]], "v double")
    h = {r.bin: r["count"] for r in A.histogram(df, "v", 10, 0.0, 10.0).collect()}
    assert h[9] == 2 and h[0] == 2 and sum(h.values()) == 5   # 10.0 in the last bin; outside and NULL dropped


def test_describe_matches_numpy(spark):
    vals = [float(x) for x in np.random.default_rng(1).integers(0, 100, 501)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = A.describe(df, ["v"]).first()
    assert r["count"] == 501
    assert np.isclose(r.p25, np.percentile(vals, 25)) and np.isclose(r.p75, np.percentile(vals, 75))
    assert np.isclose(r["std"], np.std(vals, ddof=1))



def test_describe_several_columns_per_group(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(a), float(b) if b % 4 else None) for g, a, b in
            zip(rng.integers(0, 3, 300).tolist(), rng.integers(0, 50, 300), rng.integers(0, 90, 300))]
    df = spark.createDataFrame(rows, "g long, a double, b double")
    got = {(r.g, r.column_name): r for r in A.describe(df, ["a", "b"], by="g").collect()}
    assert len(got) == 6
    for g in range(3):
        for c, i in (("a", 1), ("b", 2)):
            vals = [r[i] for r in rows if r[0] == g and r[i] is not None]
            r = got[(g, c)]
            assert r["count"] == len(vals) and np.isclose(r.p50, np.percentile(vals, 50))
            assert np.isclose(r["mean"], np.mean(vals)) and r["max"] == max(vals)

def test_value_counts_and_text(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "c string")
    vc = {r.c: r["count"] for r in A.value_counts(df, "c", dropna=False).collect()}
    assert vc == {"a": 1, "b": 2, None: 1}
    t = A.describe_text(df, "c").first()
    assert (t.n_values, t.n_unique, t.top, t.freq) == (3, 2, "b", 2)



def test_value_counts_share_with_and_without_groups(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "b"), ("y", "a"), ("y", None)], "g string, c string")
    flat = {r.c: r.share for r in A.value_counts(df, "c", normalize=True).collect()}
    assert flat == {"a": 0.5, "b": 0.5}
    per = {(r.g, r.c): r.share for r in A.value_counts(df, "c", by="g", normalize=True, dropna=False).collect()}
    assert per == {("x", "a"): 1 / 3, ("x", "b"): 2 / 3, ("y", "a"): 0.5, ("y", None): 0.5}

def test_fraction_counts_null_as_false(spark):
    df = spark.createDataFrame([(1.0,), (None,), (10.0,), (8.0,)], "v double")
    assert A.fraction_by(df, None, {"f": F.col("v") > 7}).first().f == 0.5


def test_linear_trend_and_corr(spark):
    df = spark.createDataFrame([("a", 2000 + i, 2.0 * i + 1) for i in range(5)] + [("b", 2000 + i, -i * 1.0) for i in range(5)],
                               "g string, year int, y double")
    t = {r.g: (round(r.slope, 9), round(r.intercept, 6)) for r in A.linear_trend(df, ["g"], "year", "y").collect()}
    assert t["a"][0] == 2.0
    c = {(r.group_a, r.group_b): r.corr for r in A.corr_matrix(df, "g", "year", "y").collect()}
    assert np.isclose(c[("a", "b")], -1.0)


def test_rule_violations_and_check_counts(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (5.0, 2.0, 3.0), (None, 2.0, 3.0)], "lo double, mid double, hi double")
    r = Q.rule_violations(df, {"lo_gt_mid": F.col("lo") > F.col("mid")}).first()
    assert r.any_lo_gt_mid is True and r.n_lo_gt_mid == 1
    assert Q.check_counts(df, expected_rows=3).first().rows == 3
    import pytest

    with pytest.raises(Exception):
        Q.check_counts(df, expected_rows=4).collect()


def test_top_k_by_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "g string, v int")
    got = A.top_k(df, 2, [F.col("v").desc()], by=["g"]).collect()
    assert sorted((r.g, r.v) for r in got) == [("a", 8), ("a", 9), ("b", 1), ("b", 2)]


def test_with_group_stats_equals_window(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", None), (None, 2.0)], "g string, v double")
    key = lambda t: tuple((x is None, x) for x in t)
    got = sorted(((r.g, r.v, r.m, r.n) for r in A.with_group_stats(df, "g", {"m": F.avg("v"), "n": F.count("v")})
                  .collect() if r.g is not None), key=key)
    w = Window.partitionBy("g")
    want = sorted(((r.g, r.v, r.m, r.n) for r in df.select("*", F.avg("v").over(w).alias("m"),
                                                             F.count("v").over(w).alias("n")).collect()
                   if r.g is not None), key=key)
    assert got == want
    assert A.with_group_stats(df, "g", {"m": F.avg("v")}).count() == 5         # every row kept
