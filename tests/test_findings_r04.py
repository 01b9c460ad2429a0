"""What the finding of round 4 asked for: a row per pair and sample costs little, and the rows stay the same."""

import math
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from stationlab.functions.columns import MIX_FINAL_OFFSETS, MIX_MODULUS, MIX_MULTIPLIER, MIX_OFFSET
from stationlab.operators import continuity as SP
from stationlab.plans.tidy import rounded

STATS = list(SP.MATRIX_STATS.values())


def _sides(pairs, seed, columns=2):
    """(n, state, means of each column) of the early and the late side, with missing sides and empty bins."""
    r, out = random.Random(seed), []
    for _ in range(2):
        n = [r.choice([None, 1, 2, 3, 5, 7]) for _ in range(pairs)]
        means = [[[r.choice([None, r.gauss(15, 1), r.gauss(15, 1), r.gauss(15, 1)]) for _ in range(k or 0)] for k in n] for _ in range(columns)]
        out += [pa.array(n, pa.int32()), pa.array([r.randrange(MIX_MODULUS) for _ in n], pa.int64()), *[pa.array(m, pa.list_(pa.float64())) for m in means]]
    return out


def test_draws_are_the_rounds_of_the_sql():
    m, bins, n_samples = MIX_MODULUS, 13, 500
    states = [0, 1, 2, m - 1, m - 2, m // 2, 46341, 2**30]
    stats = [SP.MatrixStatistic(lambda v, j=j: v[j]) for j in range(bins)]
    early, late = ([pa.array([bins] * len(states)), pa.array(states), pa.array([means] * len(states))] for means in ([float(b) for b in range(bins)], [0.0] * bins))
    got = SP._pair_figures([str(j) for j in range(bins)], 1, stats, n_samples)(*early, *late)
    for j in range(bins):
        drawn = [-v for v in got.field(j).flatten().to_pylist()]
        want = []
        for state in states:
            for sample in range(1, n_samples + 1):
                x = (state * state % m + MIX_OFFSET + sample % m * MIX_MULTIPLIER) % m
                x = (x * x % m + MIX_OFFSET + j * MIX_MULTIPLIER) % m
                for off in MIX_FINAL_OFFSETS:
                    x = (x * x % m + off) % m
                want.append(float(x % bins))
        assert drawn == want


def test_masked_statistics_equal_grouped_ones():
    sides = _sides(60, 2)
    grouped = [SP.MatrixStatistic(s.func, s.least) for s in STATS]
    a, b = (SP._pair_figures(["a", "b", "c", "d"], 2, s, 300)(*sides) for s in (STATS, grouped))
    assert all(s.masked for s in STATS) and a.equals(b)
    assert 0 < a.field(1).flatten().null_count < 60 * 300


def test_samples_leave_python_some_pairs_at_a_time():
    sides, names, n = _sides(50, 3), ["a", "b", "c", "d"], 100
    figures = SP._pair_figures(names, 2, STATS, n)
    groups = pa.array([None if i % 7 == 0 else f"g{i}" for i in range(50)])
    batch = pa.RecordBatch.from_arrays([groups, pa.array(range(50), pa.int32()), *sides], names=["group_id", "pair_no", *map(str, range(8))])
    for pairs in (1, 3, 1000):
        got = list(SP._figure_batches(figures, SP.PAIR, names, pairs)(iter([batch, batch.slice(0, 0)])))
        assert max(b.num_rows for b in got) == min(50, pairs)
        rows, whole = pa.Table.from_batches(got), figures(*sides)
        assert rows["group_id"].to_pylist() == groups.to_pylist() and rows["pair_no"].to_pylist() == [*range(50)]
        assert all(rows[x].combine_chunks().equals(whole.field(i)) for i, x in enumerate(names))


def test_sample_rows_equal_the_arrays_and_no_arrays_are_zipped(spark):
    r = random.Random(5)
    rows = [(g, p, s, b, 4, r.choice([None, r.gauss(5, 2)])) for g in (1, None) for p in range(3) for s in ("early", "late")[: 1 + (p > 0)] for b in range(4)]
    bins = spark.createDataFrame(rows, "group_id int, pair_no int, side string, bin int, n_bins int, v double")
    flat = SP.bootstrap_diffs(bins, ["v"], 30, 3)
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "arrays_zip" not in plan
    key = lambda x: (x[0] is None, *x[1:3])
    arrays = [(x.group_id, x.pair_no, i + 1, *v) for x in SP.bootstrap_diffs(bins, ["v"], 30, 3, per_pair=True).collect() for i, v in enumerate(zip(*x._figures))]
    assert sorted(map(tuple, flat.collect()), key=key) == sorted(arrays, key=key) and len(arrays) == 6 * 30
    assert flat.schema["group_id"].dataType == bins.schema["group_id"].dataType and flat.schema["sample"].dataType.simpleString() == "int"


def test_the_function_needs_no_package_on_the_executors(tmp_path):
    for i, f in enumerate((SP._pair_figures(["a", "b"], 1, STATS, 5), SP._figure_batches(SP._pair_figures(["a", "b"], 1, STATS, 5), SP.PAIR, ["a", "b"], 9))):
        (tmp_path / f"f{i}").write_bytes(cloudpickle.dumps(f))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-I", "-c", f"import pickle, sys\nfor i in range(2): pickle.load(open(r'{tmp_path}/f%d' % i, 'rb'))\nassert 'stationlab' not in sys.modules"],
                          env=env, cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert said.returncode == 0, said.stderr


def test_rounding_is_that_of_spark(spark):
    r = random.Random(6)
    values = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -0.00001, 0.00005, -0.00005, 0.00015, 1.00005, 2.67495, -3.14155, 1e-300, 1e300, 2.0**33 / 1e4, 1e9 + 0.00005, 123456.78905, 5e-324]
    values += [r.randrange(-10**9, 10**9) / 10**5 for _ in range(4000)]                                  # a tenth are halves
    values += [x for k in (r.randrange(-10**7, 10**7) * 10 + 5 for _ in range(500)) for v in [k / 1e5] for x in (math.nextafter(v, -math.inf), v, math.nextafter(v, math.inf))]
    values += [r.gauss(0, 1) * 10.0 ** r.randrange(-8, 14) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 4):
        bad = df.select("v", rounded(F.col("v"), digits).alias("a"), F.round("v", digits).alias("b")).where(~F.col("a").eqNullSafe(F.col("b")) | (F.col("a").cast("string") != F.col("b").cast("string")))
        assert bad.collect() == []
    plan = df.select(rounded(F.col("v"), 4))._jdf.queryExecution().optimizedPlan().toString()
    assert "rint" in plan.lower()
