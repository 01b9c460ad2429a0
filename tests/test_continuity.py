import datetime as dt

from stationlab.operators import continuity as SP

K = ["usaf", "wban"]


def groups(spark):
    rows = [(0, "1", "A", "one", 0), (1, "2", "A", "two", 0), (1, "3", "A", "three", 1),
            (2, "4", "A", "four", 0), (2, "5", "A", "five", 1), (2, "6", "A", "six", 2)]
    return spark.createDataFrame(rows, "pair_id int, usaf string, wban string, name string, ordinal int")


def test_pairs_from_groups_of_one_two_three(spark):
    p = SP.splice_pairs(groups(spark), K)
    got = sorted((r.group_id, r.a_usaf, r.b_usaf) for r in p.collect())
    assert got == [(1, "2", "3"), (2, "4", "5"), (2, "5", "6")]


def _daily(spark):
    recs = []
    d0 = dt.date(1990, 1, 1)
    for key, start, n in (("2", 0, 4000), ("3", 3999, 4000)):
        for i in range(n):
            recs.append((key, "A", d0 + dt.timedelta(days=start + i), float(i % 17) + (5.0 if key == "3" else 0.0)))
    return spark.createDataFrame(recs, "usaf string, wban string, timestamp date, v double")


def test_splice_day_on_both_sides_and_bins(spark):
    daily = _daily(spark)
    pairs = SP.splice_pairs(groups(spark), K).where("group_id = 1")
    order = SP.splice_order(daily, pairs, K, "timestamp").first()
    assert order.early_member == 0 and order.tie is False
    bins = SP.splice_windows(daily, pairs, K, "timestamp", ["v"], window_years=2)
    sides = {r.side: r for r in bins.where("bin = 0").collect()}
    assert set(sides) == {"early", "late"}
    assert {r.n_bins for r in bins.collect()} == {2}


def test_tie_on_equal_last_dates(spark):
    recs = [(k, "A", dt.date(2000, 1, 1) + dt.timedelta(days=i), 1.0) for k in ("2", "3") for i in range(30)]
    daily = spark.createDataFrame(recs, "usaf string, wban string, timestamp date, v double")
    pairs = SP.splice_pairs(groups(spark), K).where("group_id = 1")
    r = SP.splice_order(daily, pairs, K, "timestamp").first()
    assert r.tie is True and r.early_member == 0


def test_bootstrap_stable_under_repartition(spark):
    daily = _daily(spark)
    pairs = SP.splice_pairs(groups(spark), K).where("group_id = 1")
    bins = SP.splice_windows(daily, pairs, K, "timestamp", ["v"], window_years=3)
    a = SP.bootstrap_ci(SP.bootstrap_diff(SP.bootstrap_samples(bins, ["v"], 200, seed=3))).collect()
    b = SP.bootstrap_ci(SP.bootstrap_diff(SP.bootstrap_samples(bins.repartition(7), ["v"], 200, seed=3))).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    mean_row = [r for r in a if r.measure == "v" and r.statistic == "mean"][0]
    assert mean_row.q_2_5 <= mean_row.q_50 <= mean_row.q_97_5
    assert 3.0 < mean_row.q_50 < 7.0   # the late station reads 5 higher


def test_empty_bin_can_be_drawn_and_is_skipped(spark):
    import hashlib

    import numpy as np

    from stationlab.functions import columns as X

    # one side with bins [1.0, empty, 4.0]: draws that land on the empty bin are skipped by the
    # statistics; a sample that only drew the empty bin has NULL statistics
    bins = spark.createDataFrame([(5, 0, "early", 0, 3, 1.0), (5, 0, "early", 1, 3, None), (5, 0, "early", 2, 3, 4.0)],
                                 "group_id int, pair_no int, side string, bin int, n_bins int, v double")
    got = {r.sample: r for r in SP.bootstrap_samples(bins, ["v"], 300, seed=9).collect()}
    m = X.MIX_MODULUS
    h0 = int(hashlib.md5(b"9|5|0|early").hexdigest()[:8], 16) % m

    def rnd(x, v, off=X.MIX_OFFSET):
        return ((x * x) % m + off + (0 if v is None else (v % m) * X.MIX_MULTIPLIER)) % m

    values = [1.0, None, 4.0]
    hit_empty = 0
    for s in range(1, 301):
        hs = rnd(h0, s)
        picked = []
        for d in range(3):
            x = rnd(hs, d)
            for off in X.MIX_FINAL_OFFSETS:
                x = rnd(x, None, off)
            picked.append(values[x % 3])
        kept = [v for v in picked if v is not None]
        hit_empty += len(kept) < 3
        r = got[s]
        if not kept:
            assert r.v__mean is None
        else:
            assert np.isclose(r.v__mean, np.mean(kept))
            if len(kept) > 1:
                assert np.isclose(r.v__std, np.std(kept, ddof=1))
            else:
                assert r.v__std is None
    assert hit_empty > 100                                  # the empty bin is drawn about a third of the time


def test_fused_diffs_equal_composed_and_ci_matches_numpy(spark):
    import numpy as np

    daily = _daily(spark)
    pairs = SP.splice_pairs(groups(spark), K)
    bins = SP.splice_windows(daily, pairs, K, "timestamp", ["v"], window_years=3)
    composed = SP.bootstrap_diff(SP.bootstrap_samples(bins, ["v"], 120, seed=4))
    fused = SP.bootstrap_diffs(bins, ["v"], 120, seed=4)
    key = lambda r: (r.group_id, r.pair_no, r.sample)
    a = {key(r): r for r in composed.collect()}
    b = {key(r): r for r in fused.collect()}
    assert a.keys() == b.keys() and len(a) == 120
    for k2, r in a.items():
        for c in ("v__mean", "v__std"):
            assert (r[c] is None and b[k2][c] is None) or np.isclose(r[c], b[k2][c])
    ci = {(r.measure, r.statistic): r for r in SP.bootstrap_ci(fused, (0.1, 0.5, 0.9)).collect()}
    means = [r.v__mean for r in a.values() if r.v__mean is not None]
    assert np.isclose(ci[("v", "mean")].q_10, np.percentile(means, 10))
    assert np.isclose(ci[("v", "mean")].q_90, np.percentile(means, 90))


def test_report_names_a_station_in_two_groups_once_per_pair(spark):
    days = [(k, dt.date(2000, 1, 1) + dt.timedelta(days=30 * i + off), float(i % 7))
            for k, off in (("a", 0), ("b", 900), ("c", 1200)) for i in range(60)]
    daily = spark.createDataFrame(days, "key string, day date, v double")
    groups = spark.createDataFrame([(0, "a", 0, "A"), (0, "b", 1, "B"), (1, "a", 0, "A"), (1, "c", 1, "C")],
                                   "pair_id int, key string, ordinal int, name string")
    rep = SP.splice_report(daily, groups, ["key"], "day", ["v"], window_years=2, n_samples=20, seed=1).collect()
    assert sorted((r.group_id, r.statistic, r.name) for r in rep) == [(0, "mean", "A"), (0, "std", "A"), (1, "mean", "A"), (1, "std", "A")]


def test_pairs_with_a_null_key_column(spark):
    groups = spark.createDataFrame([(0, "a", "x", 0), (0, None, "y", 1), (0, "c", None, 2)], "pair_id int, k1 string, k2 string, ordinal int")
    got = sorted((r.pair_no, r.b_k1, r.b_k2) for r in SP.splice_pairs(groups, ["k1", "k2"]).collect())
    assert got == [(0, None, "y"), (1, "c", None)]
