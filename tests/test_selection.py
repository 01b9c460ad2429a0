"""Exact selection against sorting: continuous data, one group of all rows, hot values, NULLs, NaN."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlab.operators import selection

QS = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


def brute(values, q):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    if not v:
        return None
    at = q * (len(v) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return v[lo] if lo == hi else (hi - at) * v[lo] + (at - lo) * v[hi]


def check(spark, rows, qs=QS, **bounds):
    df = spark.createDataFrame(rows, "g string, h int, a double, b double")
    got = {(x.g, x.h, x.column_name): x[3:] for x in selection.exact_quantiles(df, ["a", "b"], qs, ["g", "h"], **bounds).collect()}
    groups = {(g, h) for g, h, *_ in rows}
    assert set(got) == {(*g, c) for g in groups for c in "ab"}
    for (g, h, c), figures in got.items():
        values = [r[2 if c == "a" else 3] for r in rows if r[:2] == (g, h)]
        want = [brute(values, q) for q in qs]
        assert [None if x is None else pytest.approx(x, rel=1e-12, abs=1e-12) for x in want] == list(figures), (g, h, c)


def test_groups_with_nulls_hot_values_and_many_passes(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot"] * 4 + ["x", "y", None]), r.choice([1, 1, None]), r.choice([None, 7.0, 7.0, r.gauss(0, 1), r.expovariate(1e-6)]),
             r.choice([math.nan, 0.0, -0.0, float(r.randint(-3, 3)), 2.0 ** r.randint(-900, 900)])) for _ in range(6000)]
    rows += [("one", 1, 5.5, None), ("none", 1, None, math.nan), ("two", 2, 1.0, 2.0), ("two", 2, 3.0, 2.0)]
    check(spark, rows, keep=20, accuracy=40)


def test_one_group_of_all_rows_equals_percentile(spark):
    v = np.random.RandomState(1).lognormal(size=60_000)
    df = spark.createDataFrame([(float(x),) for x in v], "a double")
    got = selection.exact_quantiles(df, "a", QS, keep=500, accuracy=100).first()
    want = df.agg(F.percentile("a", F.array(*[F.lit(q) for q in QS]))).first()[0]
    assert list(got[1:]) == pytest.approx(want, rel=1e-12) and got[0] == "a"
    assert selection.exact_median(df, "a").first()["median"] == pytest.approx(float(np.median(v)), rel=1e-12)


def test_a_value_held_by_most_rows_at_the_rank_next_to_it(spark):
    rows = [("g", 1, 7.0, float(i)) for i in range(2000)] + [("g", 1, float(i), 1.0) for i in range(2)] + [("g", 1, 100.0 + i, 1.0) for i in range(3)]
    check(spark, rows, qs=[0.0005, 0.001, 0.5, 0.998, 0.9985, 0.999], keep=1, accuracy=50)


def test_empty_tables_and_wrong_quantiles(spark):
    none = spark.createDataFrame([], "g string, a double")
    assert selection.exact_quantiles(none, "a", [0.5], "g").count() == 0
    assert selection.exact_quantiles(none, "a", [0.5]).collect()[0].asDict() == {"column_name": "a", "q0": None}
    with pytest.raises(ValueError):
        selection.exact_quantiles(none, "a", [1.5])


def test_a_rank_outside_its_sketch_is_found_all_the_same(spark):
    """Enclosing values that do not enclose the rank are widened, not trusted."""
    values = spark.range(1000).selectExpr("'g' AS _g", "double(id) AS _v")
    state = spark.createDataFrame([("g", 0.0, 999.0, 500, 10.0, 20.0)], "_g string, _min double, _max double, _r0 long, _lo0 double, _hi0 double")
    found, held = selection._narrow(values, state, ["_g"], [0])
    assert found.first()["_n"] == 998 and held.count() == 998
