"""Running figures in two levels: inside chunks of the time line, then over one row per chunk.

A running sum or maximum along a group's time line is a window ordered by time; over the whole group it
would put a hot group into one task.  Here the line is cut into chunks of ``chunk`` slots.  The first
level is a window per (group, chunk), so a group is spread over as many tasks as it has chunks; the
second level is a window over the chunks' totals (one row per group and chunk), whose results are
joined back and combined.  Rows must be aggregated already (at most one per group and slot), so a
chunk holds at most ``chunk`` rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# how two levels' figures are combined; a missing one is skipped
SUM, MAX, MIN = "sum", "max", "min"
_AGG = {SUM: F.sum, MAX: F.max, MIN: F.min}


def _combined(kind: str, a: Column, b: Column) -> Column:
    if kind == SUM:
        return F.when(a.isNull() & b.isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return F.greatest(a, b) if kind == MAX else F.least(a, b)


def carried(df: DataFrame, by: Sequence[str], slot: str, chunk: int, up: Mapping[str, tuple[str, Column]] | None = None,
            down: Mapping[str, tuple[str, Column]] | None = None, strict: bool = False,
            tasks: int | None = None) -> DataFrame:
    """Adds running figures: ``up`` ({name: (kind, expression)}) over all rows of the group up to this
    slot, ``down`` over all rows from this slot on; with ``strict`` this row itself does not count.
    ``tasks`` is the number of tasks for the windows inside chunks, if Spark is not to choose it.

    ``slot`` is an integer column.  Groups with NULL in a key are groups of their own; rows with a NULL
    slot come first."""
    up, down = dict(up or {}), dict(down or {})
    by, end = list(by), -1 if strict else 0
    x = df.withColumn("_chunk", F.floor(F.col(slot) / F.lit(chunk)).cast("long"))
    inside = Window.partitionBy(*by, "_chunk")
    frames = {"up": inside.orderBy(slot).rowsBetween(Window.unboundedPreceding, end),
              "down": inside.orderBy(F.desc(slot)).rowsBetween(Window.unboundedPreceding, end)}
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    chunks = {"up": across.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1),
              "down": across.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)}
    figures = [(way, name, kind, expr) for way, many in (("up", up), ("down", down)) for name, (kind, expr) in many.items()]
    totals = x.groupBy(*by, "_chunk").agg(*[_AGG[kind](expr).alias(f"_t{i}") for i, (_, _, kind, expr) in enumerate(figures)])
    carry = totals.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate([*by, "_chunk"])],
                          *[_AGG[kind](f"_t{i}").over(chunks[way]).alias(f"_c{i}") for i, (way, _, kind, _) in enumerate(figures)])
    if tasks:
        x = x.repartition(tasks, *by, "_chunk")
    x = x.select("*", *[_AGG[kind](expr).over(frames[way]).alias(f"_w{i}") for i, (way, _, kind, expr) in enumerate(figures)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate([*by, "_chunk"])])
    x = x.join(carry, same, "left")
    return x.select(*df.columns, *[_combined(kind, F.col(f"_w{i}"), F.col(f"_c{i}")).alias(name)
                                   for i, (_, name, kind, _) in enumerate(figures)])
