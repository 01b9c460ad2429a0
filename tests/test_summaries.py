"""Merged summaries against the rows themselves, and the pluggable statistics of the splice test."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlab.operators import continuity as SP
from stationlab.operators import summaries


@pytest.fixture(scope="module")
def data():
    r = random.Random(8)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(days=r.randint(0, 1500))
    rows = [("hot" if r.random() < 0.4 else f"k{r.randint(0, 5)}", day(), r.choice([None, math.nan, *[r.gauss(1e5, 3)] * 8]), r.randint(0, 900)) for _ in range(9000)]
    return rows + [("one", dt.date(2001, 5, 5), 7.0, 1), ("none", dt.date(2002, 1, 1), None, 1), (None, dt.date(2003, 1, 1), 1.0, 1)]


@pytest.mark.parametrize("by, span", [(["key"], (None, None)), (["key"], (2001, 2002)), (None, (None, None)), (["year"], (None, None))])
def test_merging_years_equals_reading_the_rows(spark, data, by, span):
    df = spark.createDataFrame(data, "key string, day date, v double, w long")
    s = summaries.summarise(df, "key", "day", ["v"], {"days": F.col("day"), "codes": F.col("w")})
    got = summaries.figures(summaries.merge(s, by, *span), [0.0, 0.1, 0.5, 0.99, 1.0]).collect()
    lo, hi = span[0] or 0, span[1] or 9999
    groups = {}
    for key, day, v, w in data:
        if lo <= day.year <= hi:
            groups.setdefault(None if by is None else key if by == ["key"] else day.year, []).append((day, v, w))
    assert len(got) == len(groups)
    for x in got:
        mine = groups[None if by is None else x[by[0]]]
        v = sorted(b for _, b, _ in mine if b is not None and not math.isnan(b))
        assert x.n_rows == len(mine) and x.n_v == len(v)
        assert (x.first_date, x.last_date, x.n_years) == (min(a for a, *_ in mine), max(a for a, *_ in mine), len({a.year for a, *_ in mine}))
        if not v:
            assert (x.mean_v, x.std_v, x.min_v, x.q2_v) == (None, None, None, None)
            continue
        assert x.mean_v == pytest.approx(np.mean(v), rel=1e-12) and (x.min_v, x.max_v) == (v[0], v[-1])
        assert x.std_v == (pytest.approx(np.std(v, ddof=1), rel=1e-6) if len(v) > 1 else None)
        for q, found in zip([0.0, 0.1, 0.5, 0.99, 1.0], x[[c for c in x.asDict()].index("q0_v"):][:5]):
            below, upto = sum(a < found for a in v) / len(v), sum(a <= found for a in v) / len(v)
            assert below - 0.03 <= q <= upto + 0.03
        for exact, name in ((len({a for a, *_ in mine}), "n_days"), (len({c for *_, c in mine}), "n_codes")):
            assert abs(x[name] - exact) <= max(1, 0.06 * exact)


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "key string, day date, v double")
    s = summaries.summarise(none, "key", "day", ["v"])
    assert s.count() == 0 and summaries.figures(summaries.merge(s, ["key"])).count() == 0


# statistics given by the caller --------------------------------------------------------------
def _bins(spark):
    r = random.Random(3)
    rows = [(g, 0, side, b, 7, r.choice([None, r.gauss(10, 3)])) for g in (1, 2) for side in ("early", "late") for b in range(7)]
    rows += [(3, 0, side, b, 2, None) for side in ("early", "late") for b in range(2)]
    return spark.createDataFrame(rows, "group_id int, pair_no int, side string, bin int, n_bins int, v double")


def test_any_statistic_side_by_side_with_built_in_ones(spark):
    bins = _bins(spark)
    third = lambda a: float(np.sort(a)[len(a) // 3])
    stats = {"mean": F.avg, "median": F.median, "p90": lambda c: F.percentile(c, F.lit(0.9)), "range": lambda c: F.max(c) - F.min(c),
             "third": SP.arrow_statistic(third)}
    diff = SP.bootstrap_diffs(bins, ["v"], 60, 5, stats)
    draws = {}
    for x in SP._draws(bins, ["v"], 60, 5).collect():
        draws.setdefault((x.group_id, x.pair_no, x.sample, x.side), []).append(x.v)
    brute = {"mean": np.mean, "median": np.median, "p90": lambda a: np.quantile(a, 0.9), "range": np.ptp, "third": third}
    got = diff.collect()
    assert len(got) == 3 * 60
    for x in got:
        sides = [np.array([v for v in draws[x.group_id, x.pair_no, x.sample, s] if v is not None]) for s in ("late", "early")]
        for name, f in brute.items():
            want = f(sides[0]) - f(sides[1]) if all(len(s) for s in sides) else None
            assert x[f"v__{name}"] == (None if want is None else pytest.approx(want)), name
    two_steps = SP.bootstrap_diff(SP.bootstrap_samples(bins, ["v"], 60, 5, stats))
    key = lambda x: (x.group_id, x.sample)
    for a, b in zip(sorted(got, key=key), sorted(two_steps.collect(), key=key)):
        assert [None if v is None else pytest.approx(v) for v in a] == list(b)
    ci = SP.bootstrap_ci(diff, (0.5,))
    assert {x.statistic for x in ci.collect()} == set(stats)


def test_names_of_statistics(spark):
    with pytest.raises(ValueError):
        SP.bootstrap_diffs(_bins(spark), ["v"], 5, 1, {"a__b": F.avg})
    with pytest.raises(KeyError):
        SP.bootstrap_diffs(_bins(spark), ["v"], 5, 1, ["sideways"])
