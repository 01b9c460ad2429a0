"""Splice continuity: can two stations' records be joined end to end?

All pairs run in one plan.  (pair, side) is a grouping key, the bootstrap's samples and draws
are exploded columns and every draw index comes from a hash of (seed, pair, side) mixed with
(sample, draw) in integer rounds,
so the result does not depend on partitioning, row order or task retries.  Tables after the
first aggregation are small: pairs x 2 sides x window_years bins.  The samples are not: they are pairs x
n_samples rows, so the number of tasks that make them grows with the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import MIX_FINAL_OFFSETS, MIX_MODULUS, MIX_MULTIPLIER, MIX_OFFSET, as_date, hash_seed, mix_round, with_draw
from ..plans.physical import attach, materialize

PAIR = ["group_id", "pair_no"]
# pairs whose samples one task returns as rows, made a few pairs at a time (two million rows at 2,000 samples, 5 MB of Parquet)
PAIRS_PER_TASK = 1000
# pairs of a task that holds them together: its aggregations have pairs x samples groups (up to 128 pairs Spark takes the
# quantiles without sorting), and an Arrow batch pairs x samples doubles a figure (2 MB at 2,000 samples)
PAIRS_HELD = 100
SAMPLES_PER_BATCH = 1 << 16


def _k(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def splice_pairs(groups: DataFrame, keys: Sequence[str], group_col: str = "pair_id", order_col: str = "ordinal") -> DataFrame:
    """Consecutive members of each group as pairs: a group of n stations gives n - 1
    pairs, a single station none.  Output: group_id, pair_no, ``a_<key>``, ``b_<key>``.
    The window runs over the group list (a few rows per group), never over data rows."""
    k = _k(keys)
    w = Window.partitionBy(group_col).orderBy(order_col, *k)
    x = groups.select(group_col, order_col, *k).withColumn("pair_no", F.row_number().over(w) - 1)
    for c in k:
        x = x.withColumn(f"b_{c}", F.lead(c).over(w))
    # a next member is there, whichever of its keys are NULL
    x = x.withColumn("_next", F.lead(F.lit(True)).over(w)).where("_next")
    return x.select(F.col(group_col).alias("group_id"), "pair_no",
                    *[F.col(c).alias(f"a_{c}") for c in k], *[f"b_{c}" for c in k])


def pair_members(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs in long form: (group_id, pair_no, member 0/1, key)."""
    k = _k(keys)
    a = pairs.select(*PAIR, F.lit(0).alias("member"), *[F.col(f"a_{c}").alias(c) for c in k])
    b = pairs.select(*PAIR, F.lit(1).alias("member"), *[F.col(f"b_{c}").alias(c) for c in k])
    return a.unionByName(b)


def splice_sides(daily: DataFrame, pairs: DataFrame, keys: Sequence[str], n_pairs: int | None = None) -> DataFrame:
    """The daily rows of every pair member, tagged with (group_id, pair_no, member).
    A station in two pairs (the middle of a triple) appears once per pair."""
    bound = None if n_pairs is None else 2 * n_pairs
    return attach(daily, pair_members(pairs, keys), _k(keys), bound=bound)


def splice_order(daily: DataFrame, pairs: DataFrame, keys: Sequence[str], date_col: str) -> DataFrame:
    """Per pair, which member ends first (``early``) and the splice date (its last date).
    Equal last dates: the member order decides and ``tie`` is true."""
    k = _k(keys)
    members = pair_members(pairs, k)
    last = daily.groupBy(*k).agg(F.min(as_date(date_col)).alias("first_date"), F.max(as_date(date_col)).alias("last_date"))
    m = members.join(last, k, "inner")
    w = Window.partitionBy(*PAIR).orderBy(F.col("last_date"), F.col("member"))
    m = m.withColumn("rank", F.row_number().over(w) - 1)
    agg = m.groupBy(*PAIR).agg(
        F.max(F.when(F.col("rank") == 0, F.col("member"))).alias("early_member"),
        F.min(F.when(F.col("rank") == 0, F.col("last_date"))).alias("splice_date"),
        (F.min("last_date") == F.max("last_date")).alias("tie"),
        F.count(F.lit(1)).alias("_n"),
    )
    return agg.where(F.col("_n") == 2).drop("_n")


def splice_windows(daily: DataFrame, pairs: DataFrame, keys: Sequence[str], date_col: str, value_cols: Sequence[str],
                   window_years: int = 10, bin_days: int = 365) -> DataFrame:
    """Per pair, the early side's last ``window_years*365`` days and the late side's first
    ``window_years*365`` days from its first date on or after the splice date (the splice day may
    be on both sides); each side binned in ``bin_days`` bins counted back from that side's last
    date in its window, mean per bin, empty bins kept (NULL means).

    Output: group_id, pair_no, side ('early'/'late'), bin, bin_end, n_bins, and one mean per
    value column."""
    k = _k(keys)
    span = window_years * 365 - 1
    # The pair list is a short input: count it once; every per-pair table below has at most
    # 2 x n_pairs rows, a proven bound, so those tables are broadcast without re-counting.
    bound = 2 * pairs.count()
    daily = daily.select(*k, as_date(date_col).alias("_d"), *value_cols)
    order = splice_order(daily, pairs, k, "_d").select(*PAIR, "early_member", "splice_date")
    early = F.col("member") == F.col("early_member")
    sides = attach(pair_members(pairs, k), order, PAIR, bound=bound) \
        .select(*PAIR, *k, F.when(early, "early").otherwise("late").alias("side"), "splice_date",
                # The early side's window ends at the splice date, the late side starts on or after it
                F.when(early, F.date_sub("splice_date", span)).otherwise(F.col("splice_date")).alias("_from"))
    # Each bound is a conditional minimum or maximum over the dates alone, aggregated map-side; only
    # these per-side figures are kept, the rows are read again (two narrow passes) and never written.
    days = daily.select(*k, "_d")
    first = attach(days, sides, k, bound=bound).where(F.col("_d") >= F.col("_from")) \
        .groupBy(*PAIR, "side", "splice_date").agg(F.min("_d").alias("_first"))
    sides = sides.drop("_from").join(first.drop("splice_date"), PAIR + ["side"])
    sides = materialize(sides.withColumn("_to", F.when(F.col("side") == "early", F.col("splice_date")).otherwise(F.date_add("_first", span))))
    last = attach(days, sides, k, bound=bound).where(F.col("_d").between(F.col("_first"), F.col("_to"))) \
        .groupBy(*PAIR, "side").agg(F.max("_d").alias("_anchor"))
    sides = materialize(sides.select(*PAIR, "side", *k, "_first").join(last, PAIR + ["side"]))
    # C4: bins counted back from the last date present in the window, one aggregation to (pair, side, bin)
    rows = attach(daily, sides, k, bound=bound).where(F.col("_d").between(F.col("_first"), F.col("_anchor")))
    b = F.floor(F.datediff(F.col("_anchor"), F.col("_d")) / F.lit(bin_days)).cast("int")
    means = rows.groupBy(*PAIR, "side", b.alias("bin")).agg(*[F.avg(c).alias(c) for c in value_cols])
    nb = sides.withColumn("n_bins", F.floor(F.datediff("_anchor", "_first") / F.lit(bin_days)).cast("int") + 1)
    spine = nb.select(*PAIR, "side", "n_bins", "_anchor", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    out = spine.join(means, PAIR + ["side", "bin"], "left")
    return out.withColumn("bin_end", F.date_sub(F.col("_anchor"), F.col("bin") * F.lit(bin_days))).drop("_anchor") \
        .select(*PAIR, "side", "bin", "bin_end", "n_bins", *value_cols)


def _spread(bins: DataFrame, pairs: int) -> DataFrame:
    """The small bin table, written once and hash-partitioned by pair into parts of about ``pairs`` pairs."""
    bins = materialize(bins)
    parts = math.ceil(bins.select(*PAIR).distinct().count() / pairs)
    return bins.repartition(max(parts, 2 * bins.sparkSession.sparkContext.defaultParallelism, 1), *PAIR)


def _draws(bins: DataFrame, value_cols: Sequence[str], n_samples: int, seed: int) -> DataFrame:
    """C5's draws: per (pair, side) and sample 1..n_samples, n_bins bins drawn with replacement;
    one row per draw with the drawn bin's means (NULL for an empty bin).

    Each side's bin means travel as one sorted array (at most ``window_years`` entries, so the
    collected group is bounded); draws are exploded next to it and read by index, so no join is
    needed.  The bins are hash-partitioned by pair before that collect (one shuffle of the small
    bin table; the collect by (pair, side) reuses it) and before expanding: they are spread over
    the cluster (otherwise AQE coalesces it into one task), both sides of a pair land in the same
    task, and every aggregation downstream that groups by pair (plus sample) reuses that
    partitioning instead of shuffling the draws."""
    per_side = _spread(bins, PAIRS_HELD).groupBy(*PAIR, "side").agg(
        F.max("n_bins").alias("n_bins"),
        F.sort_array(F.collect_list(F.struct("bin", *value_cols))).alias("_arr"))
    # The md5 of (seed, pair, side) is taken once per side; a sample's state is one integer
    # round on it, and each draw one more, so the per-draw work is a few multiplications.
    per_side = per_side.withColumn("_h", hash_seed(F.lit(seed), "group_id", "pair_no", "side"))
    draws = per_side.select(*PAIR, "side", "n_bins", "_arr", "_h",
                            F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("sample")) \
        .withColumn("_hs", mix_round("_h", "sample")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("draw"))
    draws = with_draw(draws, "_idx", "n_bins", "_hs", "draw")
    picked = F.element_at(F.col("_arr"), F.col("_idx").cast("int") + 1)
    return draws.select(*PAIR, "side", "sample", *[picked[c].alias(c) for c in value_cols])


Statistic = Callable[[Column], Column]


class MatrixStatistic:
    """A statistic of many samples at once.  ``func`` gets a float matrix, one sample a column, of the samples'
    non-NULL values (``least`` or more of them, equally many in every column) and returns one float per
    column; a sample with fewer values gives NULL.

    ``masked``, if given, is the same statistic of samples that hold NULLs: it gets the matrix with 0 for a
    NULL, a matrix with 1 where there is a value and 0 elsewhere, and the number of values per column.  Without it
    the samples are grouped by their number of values, which takes several times as long.

    :func:`bootstrap_diffs` takes these without one row per draw; as a function of a column it is an
    aggregate like any other."""

    def __init__(self, func: Callable[[np.ndarray], np.ndarray], least: int = 1,
                 masked: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None):
        self.func, self.least, self.masked = func, max(least, 1), masked

    def __call__(self, c: Column) -> Column:
        func, least = self.func, self.least
        return arrow_statistic(lambda v: float(func(v[:, None])[0]) if len(v) >= least else None)(c)


STAT_FUNCS = {"mean": F.avg, "std": F.stddev_samp}
MATRIX_STATS = {"mean": MatrixStatistic(lambda v: v.mean(axis=0), 1, lambda v, there, many: v.sum(axis=0) / many),
                "std": MatrixStatistic(lambda v: v.std(axis=0, ddof=1), 2, lambda v, there, many:
                                       np.sqrt(np.square((v - v.sum(axis=0) / many) * there).sum(axis=0) / (many - 1)))}


def _statistics(stats: Sequence[str] | Mapping[str, Statistic], known: Mapping[str, Statistic] = STAT_FUNCS) -> dict[str, Statistic]:
    """Names of built-in statistics, or names with functions from a column to an aggregate column."""
    named = dict(stats) if isinstance(stats, Mapping) else {s: known[s] for s in stats}
    if any("__" in s for s in named):
        raise ValueError("a statistic's name holds no double underscore")
    return named


def arrow_statistic(func: Callable[[np.ndarray], float | None]) -> Statistic:
    """A statistic without a Column form: ``func`` gets the non-NULL values of one sample (as many as a
    side has bins, at most) as a float array; no value at all gives NULL."""
    def run(samples: pa.Array) -> pa.Array:
        return pa.array([func(np.asarray(v, dtype=float)) if v else None for v in samples.to_pylist()], pa.float64())

    def stat(c: Column) -> Column:
        return F.arrow_udf(run, "double")(F.sort_array(F.collect_list(c.cast("double"))))

    return stat


def _pair_figures(names: Sequence[str], n_cols: int, stats: Sequence[MatrixStatistic], n_samples: int):
    """The Arrow function of :func:`_matrix_diffs`: for rows of (per side number of bins, state and bin means of
    each column) the samples' differences late - early, an array per figure.

    Everything it calls is inside, so that it travels to the executors whole."""
    m, mul, off, last, names = MIX_MODULUS, MIX_MULTIPLIER, MIX_OFFSET, MIX_FINAL_OFFSETS, list(names)
    funcs = [(s.func, s.least, s.masked) for s in stats]
    samples = (off + np.arange(1, n_samples + 1) % m * mul) % m
    samples = samples.astype(np.uint64)
    at_once = 1 << 15                                       # draws: their matrices stay in a core's cache

    def square(x: np.ndarray, spare: np.ndarray, folds: int = 2) -> np.ndarray:
        """x * x in place, m less often than it could be (m is 2**31 - 1: 2**31 counts as 1): x under 2**32
        gives less than m + 5 after two folds."""
        np.multiply(x, x, out=x)
        for _ in range(folds):
            np.right_shift(x, 31, out=spare)
            np.bitwise_and(x, m, out=x)
            np.add(x, spare, out=x)
        return x

    def less(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
        """m less where x is m or more: below 0 unsigned numbers are large."""
        np.subtract(x, x.dtype.type(m), out=spare)
        return np.minimum(x, spare, out=x)

    def drawn(state: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
        """n x rows x samples places from ``starts`` on, by the rounds of functions.columns.with_draw."""
        first = state.astype(np.uint64)[:, None]
        first = square(first, np.empty_like(first)) + samples
        spare = np.empty_like(first)
        first = less(square(less(first, spare), spare), spare)
        x = first[None] + ((off + np.arange(n) * mul) % m).astype(np.uint64)[:, None, None]
        spare = np.empty_like(x)
        square(x, spare)
        for add in last[:-1]:
            x += np.uint64(add)
            square(x, spare, 2 if add != last[-2] else 1)
        x = less(x, spare).astype(np.uint32)                # one fold: under 2 * m + 2**18 before
        x += np.uint32(last[-1])
        spare = np.empty_like(x)
        less(x, spare)
        np.floor_divide(x, np.uint32(n), out=spare)
        spare *= np.uint32(n)
        x -= spare
        return x + starts[:, None]

    def figures(picked: np.ndarray, there: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per statistic the values of the samples (columns) and where there is one."""
        if there is None:
            k, n = picked.shape
            return [(func(picked), np.ones(n, bool)) if k >= least else (np.zeros(n), np.zeros(n, bool)) for func, least, _ in funcs]
        out = [(np.zeros(picked.shape[1]), np.zeros(picked.shape[1], bool)) for _ in funcs]
        many = there.sum(axis=0)
        if all(masked for _, _, masked in funcs):
            with np.errstate(all="ignore"):                 # what has no value is not looked at
                return [(masked(picked, there, many), many >= least) for _, least, masked in funcs]
        there = there > 0
        picked = np.take_along_axis(picked, np.argsort(~there, axis=0, kind="stable"), axis=0)
        for k in np.unique(many[many > 0]).astype(int):
            columns = np.flatnonzero(many == k)
            v = picked[:k, columns]
            for (func, least, _), (value, known) in zip(funcs, out):
                if k >= least:
                    value[columns], known[columns] = func(v), True
        return out

    def side(n: pa.Array, state: pa.Array, lists: Sequence[pa.Array]) -> list[tuple[np.ndarray, np.ndarray]]:
        total = [(np.zeros((len(n), n_samples)), np.zeros((len(n), n_samples), bool)) for _ in range(n_cols * len(funcs))]
        sizes = n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        state = state.to_numpy(zero_copy_only=False).astype(np.int64)
        starts, columns = np.concatenate([[0], np.cumsum(sizes)])[:-1], []
        for a in lists:
            if (a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) != sizes).any():
                raise ValueError("a side has not one row for each of its n_bins bins")
            flat = a.flatten()
            valid = flat.is_valid().to_numpy(zero_copy_only=False)
            gaps = np.concatenate([[0], np.cumsum(~valid)])
            whole = gaps[starts] == gaps[starts + sizes]
            columns.append((np.where(valid, flat.to_numpy(zero_copy_only=False).astype(float), 0.0), valid.astype(float), whole))
        for k in np.unique(sizes[sizes > 0]):
            k = int(k)
            # a single bin is drawn by every sample: one sample stands for all
            width = n_samples if k > 1 else 1
            full = np.all([whole for _, _, whole in columns], axis=0)
            for same in (np.flatnonzero((sizes == k) & full), np.flatnonzero((sizes == k) & ~full)):
                for i in range(0, len(same), step := max(1, at_once // (k * width))):
                    rows = same[i:i + step]
                    at = (drawn(state[rows], k, starts[rows]) if k > 1 else starts[rows][None]).reshape(k, -1)
                    for c, (flat, valid, whole) in enumerate(columns):
                        there = None if whole[rows].all() else valid.take(at)
                        found = figures(flat.take(at), there)
                        for (value, known), (v, ok) in zip(total[c * len(funcs):], found):
                            value[rows], known[rows] = v.reshape(-1, width), ok.reshape(-1, width)
        return total

    def run(*sides: pa.Array) -> pa.Array:
        half = len(sides) // 2
        early, late = (side(x[0], x[1], x[2:]) for x in (sides[:half], sides[half:]))
        ends = pa.array(np.arange(len(sides[0]) + 1) * n_samples, pa.int32())
        diffs = [pa.ListArray.from_arrays(ends, pa.array((b - a).ravel(), pa.float64(), mask=~(known & also).ravel()))
                 for (a, known), (b, also) in zip(early, late)]
        return pa.StructArray.from_arrays(diffs, names)

    return run


def _matrix_sides(bins: DataFrame, value_cols: Sequence[str], seed: int, pairs: int) -> tuple[DataFrame, list[Column]]:
    """A row per pair, in tasks of ``pairs`` pairs, and the columns that :func:`_pair_figures` takes of it."""
    def of(side: str) -> list[Column]:
        here = F.col("side") == side
        row = F.struct("bin", *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(value_cols)])
        return [F.max(F.when(here, F.col("n_bins"))).alias(f"_n_{side}"), F.sort_array(F.collect_list(F.when(here, row))).alias(f"_arr_{side}")]

    x = _spread(bins, pairs).groupBy(*PAIR).agg(*of("early"), *of("late"))
    return x, [v for side in ("early", "late") for v in
               (F.col(f"_n_{side}"), hash_seed(F.lit(seed), "group_id", "pair_no", F.lit(side)), *[F.col(f"_arr_{side}")[f"_v{i}"] for i in range(len(value_cols))])]


def _figure_names(value_cols: Sequence[str], stats: Mapping[str, MatrixStatistic]) -> list[str]:
    return [f"{c}__{s}" for c in value_cols for s in stats]


def _matrix_diffs(bins: DataFrame, value_cols: Sequence[str], n_samples: int, seed: int, stats: Mapping[str, MatrixStatistic]) -> DataFrame:
    """:func:`bootstrap_diffs` without a row per draw: a pair's bins stand in one row, its draws are a matrix
    in Python, and only the samples' differences come back: one row per pair, with the struct ``_figures``
    of an array per figure, in the samples' order.  Nothing is grouped by sample, so nothing can spill."""
    x, asked = _matrix_sides(bins, value_cols, seed, PAIRS_HELD)
    names = _figure_names(value_cols, stats)
    kind = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])
    return x.select(*PAIR, F.arrow_udf(_pair_figures(names, len(value_cols), list(stats.values()), n_samples), kind)(*asked).alias("_figures"))


def _figure_batches(figures, keys: Sequence[str], names: Sequence[str], pairs: int):
    """The Arrow function of :func:`_matrix_rows`: the figures' arrays, of ``pairs`` pairs at a time."""
    keys, names = list(keys), list(names)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, pairs):
                part = batch.slice(i, pairs)
                diffs = figures(*part.columns[len(keys):])
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keys)], *[diffs.field(j) for j in range(len(names))]], names=[*keys, *names])

    return run


def _matrix_rows(bins: DataFrame, value_cols: Sequence[str], n_samples: int, seed: int, stats: Mapping[str, MatrixStatistic]) -> DataFrame:
    """:func:`_matrix_diffs` with a row per sample.  The arrays leave Python some pairs at a time, so a task can have many
    pairs, of which it holds a few; one of them is exploded and the others are read by place, in generated code."""
    x, asked = _matrix_sides(bins, value_cols, seed, PAIRS_PER_TASK)
    names = _figure_names(value_cols, stats)
    kind = T.StructType([*[x.schema[k] for k in PAIR], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]])
    figures = _pair_figures(names, len(value_cols), list(stats.values()), n_samples)
    x = x.select(*PAIR, *[v.alias(f"_asked{i}") for i, v in enumerate(asked)]) \
        .mapInArrow(_figure_batches(figures, PAIR, names, max(1, SAMPLES_PER_BATCH // n_samples)), kind)
    return x.select(*PAIR, *names, F.posexplode(names[0]).alias("_at", "_first")) \
        .select(*PAIR, (F.col("_at") + 1).alias("sample"), F.col("_first").alias(names[0]), *[F.get(F.col(n), F.col("_at")).alias(n) for n in names[1:]])


def _array_quantiles(names: Sequence[str], quantiles: Sequence[float]):
    """The Arrow function from a struct of arrays to a struct of their quantiles (linear, NULLs ignored, NaN largest)."""
    names, quantiles = list(names), [float(q) for q in quantiles]

    def of(values: np.ndarray) -> list[float | None]:
        if not len(values):
            return [None] * len(quantiles)
        values, out = np.sort(values), []
        for q in quantiles:
            at = (len(values) - 1) * q
            low, high = math.floor(at), math.ceil(at)
            a, b = float(values[low]), float(values[high])
            out.append(a if low == high or a == b else (high - at) * a + (at - low) * b)
        return out

    def run(figures: pa.Array) -> pa.Array:
        columns = []
        for i in range(len(names)):
            a = figures.field(i)
            flat = a.flatten()
            ends = np.concatenate([[0], np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
            v, ok = flat.to_numpy(zero_copy_only=False).astype(float), flat.is_valid().to_numpy(zero_copy_only=False)
            columns.append(pa.array([of(v[s:e][ok[s:e]]) for s, e in zip(ends, ends[1:])], pa.list_(pa.float64())))
        return pa.StructArray.from_arrays(columns, names)

    return run


def bootstrap_samples(bins: DataFrame, value_cols: Sequence[str], n_samples: int = 2000, seed: int = 0,
                      stats: Sequence[str] | Mapping[str, Statistic] = ("mean", "std")) -> DataFrame:
    """Per (pair, side) and sample, each statistic of each column over the sample's draws
    (empty bins can be drawn and are skipped by the statistics).  Output columns
    ``<column>__<statistic>``.  C9: the tests run on a pair are the ``stats`` list, all in one
    aggregation (no per-test job and no stacking of results)."""
    aggs = [f(F.col(c)).alias(f"{c}__{s}") for c in value_cols for s, f in _statistics(stats).items()]
    return _draws(bins, value_cols, n_samples, seed).groupBy(*PAIR, "side", "sample").agg(*aggs)


def bootstrap_diff(samples: DataFrame) -> DataFrame:
    """C6/C10 (A34 with the statistics of :func:`bootstrap_samples`): late - early per sample,
    one column per (value, statistic)."""
    stat_cols = [c for c in samples.columns if "__" in c]
    aggs = [(F.max(F.when(F.col("side") == "late", F.col(c))) - F.max(F.when(F.col("side") == "early", F.col(c))))
            .alias(c) for c in stat_cols]
    return samples.groupBy(*PAIR, "sample").agg(*aggs)


def bootstrap_diffs(bins: DataFrame, value_cols: Sequence[str], n_samples: int = 2000, seed: int = 0,
                    stats: Sequence[str] | Mapping[str, Statistic] = ("mean", "std"), per_pair: bool = False) -> DataFrame:
    """C5 + C6 in one aggregation: per (pair, sample), late - early of each statistic, computed
    from the draws with side-conditional aggregates.  Same result as
    ``bootstrap_diff(bootstrap_samples(...))``; grouping by (pair, sample) reuses the pair
    partitioning of the draws, so the draws are never shuffled.

    Where every statistic is a :class:`MatrixStatistic` (the named ones are) and every column a plain
    number, the draws are not rows at all (:func:`_matrix_diffs`); with ``per_pair`` the samples are not
    either, but arrays of one row per pair, which :func:`bootstrap_ci` takes as well."""
    plain = all(isinstance(bins.schema[c].dataType, (T.IntegralType, T.FloatType, T.DoubleType)) for c in value_cols)
    matrix = _statistics(stats, MATRIX_STATS)
    if n_samples > 0 and plain and all(isinstance(f, MatrixStatistic) for f in matrix.values()):
        return (_matrix_diffs if per_pair else _matrix_rows)(bins, value_cols, n_samples, seed, matrix)
    late, early = F.col("side") == "late", F.col("side") == "early"
    aggs = [(f(F.when(late, F.col(c))) - f(F.when(early, F.col(c)))).alias(f"{c}__{s}")
            for c in value_cols for s, f in _statistics(stats).items()]
    return _draws(bins, value_cols, n_samples, seed).groupBy(*PAIR, "sample").agg(*aggs)


def bootstrap_ci(diff: DataFrame, quantiles: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
    """Quantiles (linear, NULLs ignored) of each difference, in long form:
    group_id, pair_no, measure, statistic, q_<p> ...

    From arrays per pair (:func:`bootstrap_diffs` with ``per_pair``) they are read row by row.  From rows:
    one ``percentile`` over an array of quantiles per difference column (one value buffer per
    column, bounded by the number of samples), grouped by pair -- no shuffle when ``diff`` is
    still partitioned by pair -- then the small per-pair result is turned into long form."""
    if "_figures" in diff.columns:
        stat_cols = diff.schema["_figures"].dataType.names
        wide = diff.select(*PAIR, F.arrow_udf(_array_quantiles(stat_cols, quantiles), diff.schema["_figures"].dataType)("_figures").alias("_q"))
        wide = wide.select(*PAIR, *[F.col("_q")[c].alias(f"_q{i}") for i, c in enumerate(stat_cols)])
    else:
        stat_cols = [c for c in diff.columns if "__" in c]
        qs = F.array(*[F.lit(float(q)) for q in quantiles])
        wide = diff.groupBy(*PAIR).agg(*[F.percentile(F.col(c), qs).alias(f"_q{i}") for i, c in enumerate(stat_cols)])
    rows = []
    for i, c in enumerate(stat_cols):
        measure, statistic = c.split("__", 1)
        rows.append(F.struct(F.lit(measure).alias("measure"), F.lit(statistic).alias("statistic"),
                             *[F.col(f"_q{i}")[j].alias(_qname(q)) for j, q in enumerate(quantiles)]))
    return wide.select(*PAIR, F.inline(F.array(*rows)))


def _qname(q: float) -> str:
    return "q_" + f"{q * 100:g}".replace(".", "_")


def splice_report(daily: DataFrame, groups: DataFrame, keys: Sequence[str], date_col: str, value_cols: Sequence[str],
                  window_years: int = 10, n_samples: int = 2000, quantiles: Sequence[float] = (0.025, 0.5, 0.975),
                  seed: int = 0, group_col: str = "pair_id", order_col: str = "ordinal",
                  name_col: str | None = "name", stats: Sequence[str] | Mapping[str, Statistic] = ("mean", "std")) -> DataFrame:
    """Pairs -> windows -> bootstrap -> confidence report, named by the pair's first station.
    U4: every pair runs in the same plan, so there is no per-pair result to stack."""
    k = _k(keys)
    pairs = splice_pairs(groups, k, group_col, order_col)
    bins = splice_windows(daily, pairs, k, date_col, value_cols, window_years)
    ci = bootstrap_ci(bootstrap_diffs(bins, value_cols, n_samples, seed, stats, per_pair=True), quantiles)
    if name_col and name_col in groups.columns:
        # by group too: a station listed in several groups names each of its pairs once
        first = ["group_id", *[f"a_{c}" for c in k]]
        names = groups.select(F.col(group_col).alias("group_id"), *[F.col(c).alias(f"a_{c}") for c in k], F.col(name_col).alias("name")) \
            .groupBy(*first).agg(F.min("name").alias("name"))
        ci = ci.join(pairs, PAIR).join(names, first, "left").drop(*[f"a_{c}" for c in k],
                                                                                 *[f"b_{c}" for c in k])
    return ci


def order_by_shift(report: DataFrame, measure: str, statistic: str = "mean", col: str = "q_50") -> DataFrame:
    """Pairs sorted by the median shift of one measure (sort only at the sink)."""
    return report.where((F.col("measure") == measure) & (F.col("statistic") == statistic)).orderBy(col, *PAIR)
