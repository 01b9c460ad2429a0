"""As-of lookup, interval join, sweeps and day runs against brute force: NULLs, ties, repeated rows, a key
with a third of all rows, chunk borders; and their plans."""

import collections
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from stationlab.operators import sweep, timejoin
from stationlab.operators.carry import MAX, MIN, SUM, carried

D0 = dt.date(2000, 1, 1)


def day(n):
    return None if n is None else D0 + dt.timedelta(days=n)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def key_rows(r, n, keys=9, span=1500):
    """(key, day number, value); key 0 has a third of the rows."""
    out = [(0 if r.random() < 1 / 3 else r.randint(1, keys), r.randint(-span, span), r.randint(0, 5)) for _ in range(n)]
    return out + [(None, 3, 1), (2, None, 1), out[0], out[0]]


# carried -------------------------------------------------------------------------------------
@pytest.mark.parametrize("strict", [False, True])
def test_carried_equals_one_window(spark, strict):
    r = random.Random(1)
    rows = sorted({(r.choice([None, "a", "b"]), r.randint(-300, 300)) for _ in range(400)}, key=str)
    rows = [(g, s, r.choice([None, r.randint(-9, 9)])) for g, s in rows]
    df = spark.createDataFrame(rows, "g string, s long, v long")
    got = carried(df, ["g"], "s", 17, up={"total": (SUM, F.col("v")), "top": (MAX, F.col("v"))}, down={"least": (MIN, F.col("v"))}, strict=strict)
    for x in got.collect():
        mine = [(s, v) for g, s, v in rows if g == x.g and v is not None]
        before = [v for s, v in mine if s < x.s or s == x.s and not strict]
        after = [v for s, v in mine if s > x.s or s == x.s and not strict]
        assert (x.total, x.top, x.least) == (sum(before) if before else None, max(before, default=None), min(after, default=None))


# as-of ---------------------------------------------------------------------------------------
def brute_asof(rows, targets):
    by = collections.defaultdict(dict)
    for k, t, v in rows:
        if k is not None and t is not None:
            by[k][t] = min(v, by[k].get(t, v))
    out = []
    for k, t, tag in targets:
        line = by.get(k, {}) if t is not None else {}
        nxt = min((x for x in line if x >= t), default=None) if line else None
        prev = max((x for x in line if x <= t), default=None) if line else None
        near = min(line, key=lambda x: (abs(x - t), x), default=None) if line else None
        out.append((k, day(t), tag, *[y for x in (nxt, prev, near) for y in (day(x), line.get(x))]))
    return sorted(out, key=str)


METHODS = {"nxt": "bfill", "prev": "ffill", "near": "nearest"}


@pytest.mark.parametrize("chunk", [1, 30, 366, 100_000])
def test_asof_many_targets_on_a_hot_key(spark, chunk):
    r = random.Random(chunk)
    rows = key_rows(r, 900)
    targets = [(0, r.randint(-1700, 1700), i) for i in range(1000)] + [(r.randint(1, 12), r.randint(-1700, 1700), i) for i in range(300)]
    targets += [(None, 5, 1), (3, None, 1), (77, 0, 1), targets[0], targets[0]]
    left = spark.createDataFrame([(k, day(t), v, "x") for k, t, v in rows], "k long, at date, v long, tag string")
    right = spark.createDataFrame([(k, day(t), i) for k, t, i in targets], "k long, want date, tag long")
    got = timejoin.asof_lookup(left, right, "k", "at", "want", METHODS, values=["v"], chunk_days=chunk)
    assert got.columns == ["k", "want", "tag", "nxt", "nxt_v", "prev", "prev_v", "near", "near_v"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_asof(rows, targets)


def test_asof_on_timestamps_and_two_keys(spark):
    r = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(r.randint(0, 2), "a", t0 + dt.timedelta(seconds=r.randint(0, 400_000), microseconds=r.randint(0, 999_999))) for _ in range(400)]
    targets = [(r.randint(0, 3), "a", t0 + dt.timedelta(seconds=r.randint(-9000, 400_000))) for _ in range(200)]
    got = timejoin.asof_lookup(spark.createDataFrame(rows, "k long, k2 string, at timestamp"),
                               spark.createDataFrame(targets, "k long, k2 string, want timestamp"), ["k", "k2"], "at", "want", METHODS, grain="micros")
    for x in got.collect():
        line = [t for k, _, t in rows if k == x.k]
        assert x.nxt == min((t for t in line if t >= x.want), default=None)
        assert x.prev == max((t for t in line if t <= x.want), default=None)
        assert x.near == min(line, key=lambda t: (abs(t - x.want), t), default=None)


def test_asof_empty_sides_and_wrong_arguments(spark):
    none = spark.createDataFrame([], "k long, at date")
    one = spark.createDataFrame([(1, D0)], "k long, at date")
    assert timejoin.asof_lookup(none, one, "k", "at", "at", METHODS).first()[2:] == (None, None, None)
    assert timejoin.asof_lookup(one, none, "k", "at", "at", METHODS).count() == 0
    with pytest.raises(ValueError):
        timejoin.asof_lookup(one, one, "k", "at", "at", {"x": "sideways"})


def test_asof_plan_has_no_window_per_key_over_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    targets = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    got = timejoin.asof_lookup(rows.withColumnRenamed("l_suppkey", "k"), targets.selectExpr("o_custkey k", "o_orderdate t"), "k", "l_shipdate", "t", METHODS)
    plan = plan_of(got)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # windows over rows are dealt by (key, chunk), only those over chunk totals by key
    dealt = re.findall(r"hashpartitioning\((.*?)\)", plan)
    assert any("_chunk" in d for d in dealt)


# interval join -------------------------------------------------------------------------------
@pytest.mark.parametrize("one_width", [False, True])
def test_interval_join(spark, one_width):
    r = random.Random(7)
    points = key_rows(r, 700)
    longest = 30 if one_width else 2500
    spans = [(0 if r.random() < 0.4 else r.randint(1, 10), lo := r.randint(-1500, 1500), lo + r.randint(-3, longest - 1), i) for i in range(120)]
    spans += [(None, 0, 5, 900), (1, None, 5, 901), (1, 0, None, 902), spans[0]]
    left = spark.createDataFrame([(k, day(a), day(b), i) for k, a, b, i in spans], "k long, lo date, hi date, id long")
    right = spark.createDataFrame([(k, day(t), v) for k, t, v in points], "k long, at date, v long")
    got = timejoin.interval_join(left, right, ["k"], "lo", "hi", "at", base=30 if one_width else None, one_width=one_width)
    assert got.columns == ["k", "at", "v", "lo", "hi", "id"]
    want = [(k, day(t), v, day(a), day(b), i) for k, t, v in points for k2, a, b, i in spans
            if None not in (k, t, k2, a, b) and k == k2 and a <= t <= b]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 50


def test_interval_join_meets_each_pair_once_and_spreads_a_hot_key(spark):
    points = spark.range(20_000).selectExpr("0L AS k", "date_add(DATE'1950-01-01', cast(id AS int)) AS at")
    left = spark.createDataFrame([(0, dt.date(1950, 1, 1), dt.date(2010, 1, 1), 1), (0, dt.date(1960, 1, 1), dt.date(1960, 12, 31), 2)],
                                 "k long, lo date, hi date, id long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = timejoin.interval_join(left.where("id = 2"), points, ["k"], "lo", "hi", "at", base=366, one_width=True)
        assert "_bucket" in plan_of(got).split("hashpartitioning(", 1)[1].split(")")[0]
        both = timejoin.interval_join(left, points, ["k"], "lo", "hi", "at")
        assert {x["id"]: x["count"] for x in both.groupBy("id").count().collect()} == {1: 20_000, 2: 366}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_interval_join_refuses_clashing_columns_and_takes_nothing(spark):
    a = spark.createDataFrame([], "k long, lo date, hi date")
    b = spark.createDataFrame([(1, D0)], "k long, at date")
    assert timejoin.interval_join(a, b, ["k"], "lo", "hi", "at").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        timejoin.interval_join(a, b.withColumn("lo", F.lit(1)), ["k"], "lo", "hi", "at")


# sweep ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("grid", ["month", "day"])
def test_active_intervals(spark, monkeypatch, grid):
    monkeypatch.setattr(sweep, "MONTH_CHUNK", 5)
    monkeypatch.setattr(sweep, "DAY_CHUNK", 11)
    r = random.Random(6)
    iv = [(r.choice(["a", "a", "b", None]), b := r.randint(0, 900), b + r.randint(-20, 400)) for _ in range(60)]
    iv += [("a", None, 1500), ("a", -40, None), ("c", 10, 12), ("d", None, None), iv[0]]
    df = spark.createDataFrame([(g, day(b), day(e)) for g, b, e in iv], "g string, b date, e date")

    def brute(rows):
        begins, ends = [b for _, b, _ in rows if b is not None], [e for *_, e in rows if e is not None]
        if not begins or not ends:
            return {}
        slots = [day(n) for n in range(min(begins), max(ends) + 1)]
        slots = slots if grid == "day" else [d for d in slots if d.day == 1]
        return {d: sum(None not in (b, e) and day(b) <= d <= day(e) for _, b, e in rows) for d in slots}

    got = sweep.active_intervals(df, "b", "e", grid)
    assert {x[0]: x[1] for x in got.collect()} == brute(iv) and got.columns == [grid, "active"]
    parts = collections.defaultdict(dict)
    for x in sweep.active_intervals(df, "b", "e", grid, by=["g"], out="n").collect():
        assert x[grid] not in parts[x.g]
        parts[x.g][x[grid]] = x.n
    for g in {x[0] for x in iv}:
        assert parts.get(g, {}) == brute([x for x in iv if x[0] == g])
    assert sweep.active_intervals(df.where("false"), "b", "e", grid).count() == 0


def test_sweep_rows_do_not_grow_with_interval_length(spark):
    df = spark.createDataFrame([(dt.date(1900, 1, 1), dt.date(2020, 1, 1))] * 50, "b date, e date")
    assert sweep.active_intervals(df, "b", "e", "day").agg(F.sum("active")).first()[0] == 50 * 43830


# runs ----------------------------------------------------------------------------------------
@pytest.mark.parametrize("common", [False, True])
def test_day_runs_expand_to_the_daily_grid(spark, monkeypatch, common):
    monkeypatch.setattr(sweep, "DAY_CHUNK", 7)
    r = random.Random(9)
    rows = [(r.choice([None, 0, 0, 1, 2]), r.randint(0, 160), r.choice([None, 1.5, 2.0])) for _ in range(300)]
    rows += [(5, 40, None), (5, 50, None), (6, 3, 1.0), (7, None, 1.0), (0, 1000, 1.0)]
    df = spark.createDataFrame([(k, day(t), v) for k, t, v in rows], "k long, at date, v double")
    runs = sweep.day_runs(df, "k", "at", "v", common_span=common).collect()
    days = {t for _, t, _ in rows if t is not None}
    for k in {k for k, t, _ in rows if t is not None}:
        mine = sorted([x for x in runs if x.k == k], key=lambda x: x.first_day)
        own = [t for k2, t, _ in rows if k2 == k and t is not None]
        lo, hi = (min(days), max(days)) if common else (min(own), max(own))
        present = {t for k2, t, v in rows if k2 == k and t is not None and v is not None}
        grid = [(day(t), t not in present) for t in range(lo, hi + 1)]
        assert [(x.first_day + dt.timedelta(days=i), x.missing) for x in mine for i in range(x.days)] == grid
        # runs are maximal
        assert all(a.missing != b.missing for a, b in zip(mine, mine[1:]))
    assert not [x for x in runs if x.k == 7]
