"""Exact quantiles in bounded memory (A16, A21, T9, C6): selection by narrowing value ranges.

``percentile`` keeps every distinct value of a group in one buffer.  Here a sketch of bounded size gives,
per group and wanted rank, two values that enclose it; a counting pass then says whether the rank falls
on one of the two or strictly between them, and how many values lie there.  Only values strictly between
go on (a few per mille of a group), and the step is repeated on them until a group's rest is small
enough to be sorted.  Values equal to an enclosing value are counted, never carried, so a value that a
third of all rows hold costs nothing.  Each pass shrinks the rest by a fixed factor: the number of
passes goes with the logarithm of the largest group.

The two passes over the input are map-side aggregations; what is shuffled is one sketch per task and
group, one row of counts per task and group, and the few values between.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null
from ..plans.physical import attach, materialize

# values of a group that are sorted at the end; accuracy of the sketches (rank error: 1 / accuracy)
KEEP = 50_000
ACCURACY = 2000


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _narrow(values: DataFrame, state: DataFrame, keys: list[str], ranks: list[int]) -> tuple[DataFrame, DataFrame]:
    """``state`` has, per key and rank number i, the rank _r{i}, its enclosing values _lo{i}, _hi{i} and all
    values' _min and _max.  Returns (key, _i, _r, _answer, _n): the answer where it is one of the two, else the rank
    among the _n values strictly between; and those values as (key, _i, _v)."""
    def counts(state: DataFrame) -> DataFrame:
        figures = []
        for i in ranks:
            v, lo, hi = F.col("_v"), F.col(f"_lo{i}"), F.col(f"_hi{i}")
            figures += [F.count_if(v < lo).alias(f"_a{i}"), F.count_if(v == lo).alias(f"_b{i}"),
                        F.count_if((v > lo) & (v < hi)).alias(f"_c{i}"), F.count_if((v == hi) & (hi > lo)).alias(f"_d{i}")]
        return materialize(attach(values, state, keys).groupBy(*keys).agg(*figures).join(state, keys))

    counted = counts(state)
    # the sketch's error bound makes this rare: a rank outside its enclosing values gets the whole range
    out = {i: (F.col(f"_r{i}") < F.col(f"_a{i}")) | (F.col(f"_r{i}") >= F.col(f"_a{i}") + F.col(f"_b{i}") + F.col(f"_c{i}") + F.col(f"_d{i}")) for i in ranks}
    if not counted.where(_any(list(out.values()))).isEmpty():
        state = counted.select(*keys, "_min", "_max", *[F.col(f"_r{i}") for i in ranks],
                               *[F.when(out[i], F.col("_min")).otherwise(F.col(f"_lo{i}")).alias(f"_lo{i}") for i in ranks],
                               *[F.when(out[i], F.col("_max")).otherwise(F.col(f"_hi{i}")).alias(f"_hi{i}") for i in ranks])
        state = materialize(state)
        counted = counts(state)
    rest = []
    for i in ranks:
        r, lo = F.col(f"_r{i}"), F.col(f"_a{i}") + F.col(f"_b{i}")
        answer = F.when(r < lo, F.col(f"_lo{i}")).when(r >= lo + F.col(f"_c{i}"), F.col(f"_hi{i}"))
        rest.append(F.struct(F.lit(i).alias("_i"), (r - lo).alias("_r"), answer.alias("_answer"), F.col(f"_c{i}").alias("_n"),
                             F.col(f"_lo{i}").alias("_lo"), F.col(f"_hi{i}").alias("_hi")))
    found = materialize(counted.where(F.col(f"_r{ranks[0]}").isNotNull()).select(*keys, F.inline(F.array(*rest))))
    open_ = found.where("_answer is null").select(*keys, "_i", "_lo", "_hi")
    wide = open_.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col(c))).alias(f"{c}{i}") for i in ranks for c in ("_lo", "_hi")])
    held = attach(values, wide, keys)
    inside = {i: F.coalesce((F.col("_v") > F.col(f"_lo{i}")) & (F.col("_v") < F.col(f"_hi{i}")), F.lit(False)) for i in ranks}
    held = held.where(_any(list(inside.values())))
    held = held.select(*keys, "_v", F.explode(F.array_compact(F.array(*[F.when(inside[i], F.lit(i)) for i in ranks]))).alias("_i"))
    return found.drop("_lo", "_hi"), held


def _ranked(values: DataFrame, wanted: DataFrame, keep: int, accuracy: int) -> DataFrame:
    """The value at rank ``_r`` (from 0) of each (group, rank number) of ``wanted`` (_g, _i, _r) among
    ``values`` (_g, _i, _v): _g, _i, _answer."""
    keys, steps = ["_g", "_i"], max(accuracy // 8, 2)
    done = None
    while True:
        # one small group's worth of values per (group, rank): sorted
        small = wanted.where(F.col("_n") <= keep)
        lists = values.join(small.select(*keys, "_r"), keys).groupBy(*keys, "_r").agg(F.sort_array(F.collect_list("_v")).alias("_l"))
        now = lists.select(*keys, F.element_at("_l", (F.col("_r") + 1).cast("int")).alias("_answer"))
        done = now if done is None else done.unionByName(now)
        wanted = wanted.where(F.col("_n") > keep)
        if wanted.isEmpty():
            return done
        large = values.join(wanted.select(*keys), keys, "left_semi")
        grid = F.percentile_approx("_v", [i / steps for i in range(steps + 1)], accuracy)
        sketch = large.groupBy(*keys).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"), grid.alias("_p"))
        at = F.col("_r") / F.col("_n") * steps
        below, above = F.floor(at).cast("int") - 1, F.ceil(at).cast("int") + 1
        state = materialize(wanted.join(sketch, keys).select(
            *keys, "_min", "_max", F.col("_r").alias("_r0"),
            F.when(below < 1, F.col("_min")).otherwise(F.try_element_at("_p", below + 1)).alias("_lo0"),
            F.when(above >= steps, F.col("_max")).otherwise(F.try_element_at("_p", above + 1)).alias("_hi0")))
        found, held = _narrow(large.withColumnRenamed("_i", "_j"), state.withColumnRenamed("_i", "_j"), ["_g", "_j"], [0])
        found = found.drop("_i").withColumnRenamed("_j", "_i")
        done = done.unionByName(found.where("_answer is not null").select(*keys, "_answer"))
        wanted = materialize(found.where("_answer is null").select(*keys, "_r", "_n"))
        values = materialize(held.drop("_i").withColumnRenamed("_j", "_i"))


def exact_quantiles(df: DataFrame, value_cols: Sequence[str] | str, quantiles: Sequence[float], by: Sequence[str] | str | None = None,
                    keep: int = KEEP, accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles with linear interpolation, as ``percentile`` gives them: one row per group and
    column with ``column_name`` and one column ``q0``, ``q1``, ... per entry of ``quantiles``.

    A task holds a sketch of about ``accuracy`` entries per group or ``keep`` values, never a group.
    NULL and NaN do not count; a group without values gets NULL; a NULL key is a group of its own; an
    empty table gives one row of NULLs per column without ``by``, else none."""
    k = [] if by is None else [by] if isinstance(by, str) else list(by)
    cols = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    qs = [float(q) for q in quantiles]
    if not qs or any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    # one group per (column, keys): a struct as the only key, so that NULL keys are matched like any other
    group = lambda c: F.struct(F.lit(c).alias("c"), *[F.col(f"`{x}`").alias(f"k{i}") for i, x in enumerate(k)])
    pairs = F.array(*[F.struct(group(c).alias("_g"), nan_to_null(F.col(f"`{c}`").cast("double")).alias("_v")) for c in cols])
    values = df.select(F.inline(pairs))
    slack = 2.0 / accuracy
    probes = [p for q in qs for p in (max(q - slack, 0.0), min(q + slack, 1.0))]
    some = values.groupBy("_g").agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                    F.percentile_approx("_v", probes, accuracy).alias("_p"))
    ranks = list(range(2 * len(qs)))
    places = {}
    for i, q in enumerate(qs):
        at = F.lit(q) * (F.col("_n") - 1)
        for j, rank in ((2 * i, F.floor(at)), (2 * i + 1, F.ceil(at))):
            places |= {f"_r{j}": F.when(F.col("_n") > 0, rank.cast("long")),
                       f"_lo{j}": F.col("_min") if q - slack <= 0 else F.element_at("_p", 2 * i + 1),
                       f"_hi{j}": F.col("_max") if q + slack >= 1 else F.element_at("_p", 2 * i + 2)}
    state = materialize(some.select("_g", "_n", "_min", "_max", *[c.alias(n) for n, c in places.items()]))
    found, held = _narrow(values.where("_v is not null"), state.drop("_n").where("_r0 is not null"), ["_g"], ranks)
    open_ = materialize(found.where("_answer is null").select("_g", "_i", "_r", "_n"))
    answers = found.where("_answer is not null").select("_g", "_i", "_answer")
    if not open_.isEmpty():
        answers = answers.unionByName(_ranked(materialize(held.select("_g", "_i", "_v")), open_, keep, accuracy))
    wide = answers.groupBy("_g").agg(*[F.max(F.when(F.col("_i") == j, F.col("_answer"))).alias(f"_x{j}") for j in ranks])
    figures = []
    for i, q in enumerate(qs):
        at, lo, hi = F.lit(q) * (F.col("_n") - 1), F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}")
        figures.append(F.when(F.floor(at) == F.ceil(at), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(f"q{i}"))
    groups = state.select("_g", "_n")
    if not k:  # a row per column also without any input row
        groups = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(group(c).alias("_g")) for c in cols]))).join(groups, "_g", "left")
    got = groups.join(wide, "_g", "left")
    return got.select(*[F.col(f"_g.k{i}").alias(x) for i, x in enumerate(k)], F.col("_g.c").alias("column_name"), *figures)


def exact_median(df: DataFrame, value_col: str, by: Sequence[str] | str | None = None, out: str = "median", **bounds: int) -> DataFrame:
    """A21 in bounded memory."""
    x = exact_quantiles(df, value_col, [0.5], by, **bounds)
    return x.drop("column_name").withColumnRenamed("q0", out)
