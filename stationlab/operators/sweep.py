"""Sweeps over the time line: active intervals per grid slot (J9) and runs of present and missing days
(T6, T7).  Both work on thin per-slot tables and carry running figures over chunk borders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_date
from ..plans.physical import materialize
from .carry import MAX, MIN, SUM, carried

# slots of one chunk: months of about 21 years, days of about a year
MONTH_CHUNK = 256
DAY_CHUNK = 366
GRIDS = ("month", "day")


def _slots(grid: str, begin: Column, end: Column) -> tuple[Column, Column]:
    """First slot on or after ``begin`` and last slot on or before ``end``."""
    if grid == "day":
        return F.unix_date(begin).cast("long"), F.unix_date(end).cast("long")
    month = lambda d: (F.year(d) * 12 + F.month(d) - 1).cast("long")
    return month(begin) + (F.dayofmonth(begin) > 1).cast("long"), month(end)


def slot_date(grid: str, slot: Column) -> Column:
    if grid == "day":
        return F.date_from_unix_date(slot.cast("int"))
    return F.make_date(F.floor(slot / 12).cast("int"), (F.pmod(slot, F.lit(12)) + 1).cast("int"), F.lit(1))


def active_intervals(intervals: DataFrame, begin: str, end: str, grid: str = "month", by: Sequence[str] = (),
                     out: str = "active", slot_name: str | None = None) -> DataFrame:
    """For every slot of the grid (month starts, or days) from the first begin to the last end (per
    group of ``by``), the number of intervals that cover it, both ends included.

    A sweep: an interval is +1 at its first slot and -1 after its last one, whatever its length; the
    deltas are summed per slot (map-side first), a two-level running sum gives the count from each slot
    on, and each slot with a change is repeated up to the next one.  Input is read once.  The running
    sum works on at most one row per group and slot.

    Intervals with a NULL end do not count and do not widen the grid's other end: the grid runs from the
    smallest begin to the largest end present, as the reference's does; an interval that ends before it
    begins covers nothing.  No rows: no grid."""
    if grid not in GRIDS:
        raise ValueError("grid is month or day")
    by, name = list(by), slot_name or grid
    x = intervals.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(by)], as_date(begin).alias("_b"), as_date(end).alias("_e"))
    g = [f"_g{i}" for i in range(len(by))]
    first, last = _slots(grid, F.col("_b"), F.col("_e"))
    covers = F.col("_b").isNotNull() & F.col("_e").isNotNull() & (first <= last)
    change = F.when(covers, F.lit(1)).otherwise(F.lit(0))
    # a begin opens the grid even if its interval covers no slot, an end closes it
    opens = F.struct(first.alias("_slot"), change.alias("_d"), F.lit(None).cast("long").alias("_hi"), first.alias("_lo"))
    closes = F.struct((last + 1).alias("_slot"), (-change).alias("_d"), last.alias("_hi"), F.lit(None).cast("long").alias("_lo"))
    events = x.select(*g, F.inline(F.array(opens, closes))).where("_slot is not null")
    # at most one row per group and slot of the calendar, read by both levels: written once
    deltas = materialize(events.groupBy(*g, "_slot").agg(F.sum("_d").alias("_d"), F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo")))
    chunk = MONTH_CHUNK if grid == "month" else DAY_CHUNK
    run = carried(deltas, g, "_slot", chunk, up={"_n": (SUM, F.col("_d")), "_lo1": (MIN, F.col("_lo")), "_hi1": (MAX, F.col("_hi"))},
                  down={"_hi2": (MAX, F.col("_hi")), "_lo2": (MIN, F.col("_lo"))})
    run = carried(run, g, "_slot", chunk, down={"_next": (MIN, F.col("_slot"))}, strict=True)
    low, high = F.least("_lo1", "_lo2"), F.greatest("_hi1", "_hi2")
    stop = F.least(F.coalesce(F.col("_next") - 1, high), high)
    start = F.greatest(F.col("_slot"), low)
    filled = run.where(low.isNotNull() & high.isNotNull() & (start <= stop)).select(*g, F.explode(F.sequence(start, stop)).alias("_slot"), "_n")
    return filled.select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(by)], slot_date(grid, F.col("_slot")).alias(name),
                         F.col("_n").cast("long").alias(out))


def day_runs(df: DataFrame, keys: Sequence[str] | str, date_col: str, value_col: str | None = None,
             common_span: bool = False) -> DataFrame:
    """T6/T7 as runs: per key the maximal runs of days with and without a value: key, first_day, last_day,
    days, missing.  A day is present if it has a row (with a non-NULL ``value_col``, if given).  The span is
    the key's own first to last day with a row, or with ``common_span`` the table's.

    Cost and result size go with the number of runs, not of days: days are reduced to one row per (key,
    day), the days before and after a run come from windows per (key, year chunk) carried over
    chunk borders, and only a run's two ends go on.  Rows with a NULL date do not count; NULL keys are
    one key."""
    k = [keys] if isinstance(keys, str) else list(keys)
    g = [f"_g{i}" for i in range(len(k))]
    has = F.lit(True) if value_col is None else F.col(f"`{value_col}`").isNotNull()
    day = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(k, g)], F.unix_date(as_date(date_col)).cast("long").alias("_t"), has.alias("_has"))
    day = materialize(day.where("_t is not null").groupBy(*g, "_t").agg(F.max("_has").alias("_has")))
    present = carried(day.where("_has").select(*g, "_t"), g, "_t", DAY_CHUNK, up={"_before": (MAX, F.col("_t"))},
                      down={"_after": (MIN, F.col("_t"))}, strict=True)
    last_of_run = F.col("_after").isNull() | (F.col("_after") > F.col("_t") + 1)
    present = carried(present, g, "_t", DAY_CHUNK, down={"_end": (MIN, F.when(last_of_run, F.col("_t")))})
    first_of_run = F.col("_before").isNull() | (F.col("_before") < F.col("_t") - 1)
    run = lambda first, last, missing: F.struct(first.alias("_first"), last.alias("_last"), F.lit(missing).alias("missing"))
    runs = present.where(first_of_run).select(*g, F.inline(F.array(
        run(F.col("_t"), F.col("_end"), False), run(F.col("_before") + 1, F.col("_t") - 1, True))))
    # what lies before the first and after the last present day; a key without one is missing throughout
    span = day.groupBy(*g).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.min(F.when(F.col("_has"), F.col("_t"))).alias("_p"),
                               F.max(F.when(F.col("_has"), F.col("_t"))).alias("_q"))
    if common_span:
        whole = span.agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).withColumn("_one", F.lit(1))  # one row
        span = span.drop("_lo", "_hi").withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one")
    rims = span.select(*g, F.inline(F.array(run(F.col("_lo"), F.coalesce(F.col("_p") - 1, F.col("_hi")), True),
                                            run(F.col("_q") + 1, F.col("_hi"), True))))
    both = runs.unionByName(rims).where(F.col("_first") <= F.col("_last"))
    return both.select(*[F.col(i).alias(c) for i, c in zip(g, k)], F.date_from_unix_date(F.col("_first").cast("int")).alias("first_day"),
                       F.date_from_unix_date(F.col("_last").cast("int")).alias("last_day"),
                       (F.col("_last") - F.col("_first") + 1).alias("days"), "missing")
