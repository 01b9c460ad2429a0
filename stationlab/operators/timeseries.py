"""Time binning, densifying and date lookups.

Anchored bins need each key's first or last date.  That comes from a per-key aggregate (partial
aggregation, skew-safe) attached back with a size-checked broadcast, never from a window over the
raw rows, which would put a hot station's whole series into one task.  The only window here runs
over (key, year) aggregates: at most one row per key and year.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_date
from ..plans.physical import attach, small_side
from .timejoin import interval_join

Keys = Sequence[str]


def _k(keys: Keys | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def key_extent(df: DataFrame, keys: Keys, date_col: str, first: str = "first_date", last: str = "last_date") -> DataFrame:
    """Per-key first and last date (dates, not timestamps)."""
    d = as_date(date_col)
    return df.groupBy(*_k(keys)).agg(F.min(d).alias(first), F.max(d).alias(last))


def with_key_extent(df: DataFrame, keys: Keys, date_col: str, first: str = "_first", last: str = "_last") -> DataFrame:
    """Attach each key's first/last date to its rows (aggregate + size-checked broadcast join)."""
    return attach(df, key_extent(df, keys, date_col, first, last), _k(keys))


# T1 ------------------------------------------------------------------------------------------
def year_bin(date_col: str) -> Column:
    """Calendar-year bin start (sparse: only years having rows appear after a groupBy)."""
    return F.trunc(as_date(date_col), "YEAR")


# T2 ------------------------------------------------------------------------------------------
def year_spine(bounds: DataFrame, keys: Keys, first_col: str, last_col: str, out: str = "period") -> DataFrame:
    """One row per key and calendar year from its first to its last year (year-start dates)."""
    return bounds.select(
        *_k(keys),
        F.explode(F.sequence(F.trunc(first_col, "YEAR"), F.trunc(last_col, "YEAR"), F.expr("INTERVAL 1 YEAR"))).alias(out),
    )


def densify_years(per_year: DataFrame, keys: Keys, period: str = "period", fill: dict | None = None) -> DataFrame:
    """Fill the years missing between each key's first and last year of ``per_year``.

    ``per_year`` is already aggregated to (key, year-start date), so a key has at most one row per
    year (a hot station's century is ~100 rows): a window over it orders a key's years, and each
    row explodes into itself plus the missing years up to the key's next year.  No bounds
    aggregate and no spine join, so the aggregated table is the only input (a bounds aggregate
    would be rewritten by Catalyst into a second scan of the raw rows).  ``fill`` gives values
    for filled rows and for NULLs (e.g. 0 for counts and sums); other columns are NULL in
    filled rows.  Rows whose year is NULL are dropped.
    """
    k = _k(keys)
    fill = dict(fill or {})
    w = Window.partitionBy(*k).orderBy(period)
    x = per_year.withColumn("_next", F.lead(period).over(w))
    last = F.coalesce(F.add_months(F.col("_next"), -12), F.col(period))
    x = x.withColumn("_p", F.explode(F.sequence(F.col(period), last, F.expr("INTERVAL 1 YEAR"))))
    real = F.col("_p") == F.col(period)
    cols = []
    for c in per_year.columns:
        if c in k or c == period:
            continue
        v = F.when(real, F.col(c))
        cols.append((F.coalesce(v, F.lit(fill[c])) if c in fill else v).alias(c))
    return x.select(*k, F.col("_p").alias(period), *cols)


# T3 ------------------------------------------------------------------------------------------
def anchored_month_bins(df: DataFrame, keys: Keys, date_col: str, months: int = 12,
                        out_start: str = "period_start", out_end: str = "period_end") -> DataFrame:
    """Bins of ``months`` months starting at the month of each key's first row (not January).

    Adds the bin's start and end (start + months).  Only bins that have rows can appear.
    """
    k = _k(keys)
    ext = key_extent(df, k, date_col, "_first", "_last").select(*k, F.trunc("_first", "MM").alias("_anchor"))
    x = attach(df, ext, k)
    n = F.floor(F.months_between(F.trunc(as_date(date_col), "MM"), F.col("_anchor")) / F.lit(months)).cast("int")
    start = F.add_months(F.col("_anchor"), n * F.lit(months))
    return x.withColumn(out_start, start).withColumn(out_end, F.add_months(start, months)).drop("_anchor")


# T4 ------------------------------------------------------------------------------------------
def anchored_day_bins(df: DataFrame, keys: Keys, date_col: str, days: int = 7,
                      out_start: str = "period_start") -> DataFrame:
    """T4: bins of ``days`` days starting at each key's first day."""
    k = _k(keys)
    ext = key_extent(df, k, date_col, "_first", "_last").select(*k, "_first")
    x = attach(df, ext, k)
    n = F.floor(F.datediff(as_date(date_col), F.col("_first")) / F.lit(days)).cast("int")
    return x.withColumn(out_start, F.date_add(F.col("_first"), n * F.lit(days))).drop("_first")


# T5 ------------------------------------------------------------------------------------------
def end_anchored_bins(df: DataFrame, keys: Keys, date_col: str, days: int = 365, out: str = "bin") -> DataFrame:
    """T5: bins of ``days`` days counted back from each key's last date; bin 0 is the last ``days``
    days, right-closed: bin = floor((last - d) / days).  Adds the bin number and its end date."""
    k = _k(keys)
    ext = key_extent(df, k, date_col, "_first", "_last").select(*k, "_last")
    x = attach(df, ext, k)
    b = F.floor(F.datediff(F.col("_last"), as_date(date_col)) / F.lit(days)).cast("int")
    return x.withColumn(out, b).withColumn(f"{out}_end", F.date_sub(F.col("_last"), b * F.lit(days))).drop("_last")


def fill_bins(per_bin: DataFrame, keys: Keys, bin_col: str = "bin") -> DataFrame:
    """The integer bins missing between each key's smallest and largest bin of ``per_bin`` (one
    row per key and bin, already aggregated), added with NULL in every other column: a window
    over the aggregate finds each bin's successor and the row explodes up to it, so no bounds
    aggregate (which Catalyst would turn into a second raw scan) and no spine join."""
    k = _k(keys)
    w = Window.partitionBy(*k).orderBy(bin_col)
    x = per_bin.withColumn("_next", F.lead(bin_col).over(w))
    x = x.withColumn("_f", F.explode(F.sequence(F.col(bin_col), F.coalesce(F.col("_next") - 1, F.col(bin_col)))))
    real = F.col("_f") == F.col(bin_col)
    others = [F.when(real, F.col(c)).alias(c) for c in per_bin.columns if c not in k and c != bin_col]
    return x.select(*k, F.col("_f").alias(bin_col), *others)


def bin_spine(bounds: DataFrame, keys: Keys, lo: str, hi: str, out: str = "bin") -> DataFrame:
    """Integer bins lo..hi per key (used to keep empty end-anchored bins)."""
    return bounds.select(*_k(keys), F.explode(F.sequence(F.col(lo), F.col(hi))).alias(out))


# T6 / T7 -------------------------------------------------------------------------------------
def day_spine(bounds: DataFrame, keys: Keys, first_col: str, last_col: str, out: str = "day") -> DataFrame:
    """One row per key and day between the key's bounds (both included)."""
    return bounds.select(*_k(keys), F.explode(F.sequence(F.col(first_col), F.col(last_col))).alias(out))


def fill_days(per_day: DataFrame, keys: Keys, day: str = "day") -> DataFrame:
    """The days missing between each key's first and last day of ``per_day`` (one row per key and
    day, already aggregated), added with NULL in every other column.

    Like :func:`densify_years`: a window over the per-day aggregate (at most one row per key and
    calendar day) finds each row's next day, and the row explodes into itself plus the days up to
    it -- no bounds aggregate (Catalyst would turn it into a second scan of the raw rows) and no
    spine join.  Rows whose day is NULL are dropped."""
    k = _k(keys)
    w = Window.partitionBy(*k).orderBy(day)
    x = per_day.withColumn("_next", F.lead(day).over(w))
    last = F.coalesce(F.date_sub(F.col("_next"), 1), F.col(day))
    x = x.withColumn("_f", F.explode(F.sequence(F.col(day), last)))
    real = F.col("_f") == F.col(day)
    others = [F.when(real, F.col(c)).alias(c) for c in per_day.columns if c not in k and c != day]
    return x.select(*k, F.col("_f").alias(day), *others)


def daily_grid(df: DataFrame, keys: Keys, date_col: str, value_col: str, out: str = "missing") -> DataFrame:
    """Each key's daily grid from its first to last day; ``missing`` = 1 where the day has no
    row or only NULL values, else 0.  Per-day values are aggregated, then the missing days are
    filled in (:func:`fill_days`)."""
    k = _k(keys)
    day = as_date(date_col).alias("day")
    per_day = df.groupBy(*k, day).agg(F.count(value_col).alias("_n"))
    grid = fill_days(per_day, k, "day")
    return grid.select(*k, "day", F.when(F.coalesce(F.col("_n"), F.lit(0)) > 0, 0).otherwise(1).alias(out))


def all_keys_grid(df: DataFrame, keys: Keys, date_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Every key x every day between the global first and last date, values where present.

    The global bounds are one row; they are fetched to the driver as two literals (a bounded
    result), so no cross join is planned: each key row generates its own day sequence.
    """
    k = _k(keys)
    lo, hi = df.agg(F.min(as_date(date_col)), F.max(as_date(date_col))).first()
    keys_df = df.select(*k).distinct()
    grid = keys_df.select(*k, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("day"))
    vals = df.select(*k, as_date(date_col).alias("day"), *value_cols)
    return grid.join(vals, k + ["day"], "left")


# T8 ------------------------------------------------------------------------------------------
def daily_sum_filled(df: DataFrame, keys: Keys, ts_col: str, value_col: str, out: str = "daily_total",
                     start: str | None = None, end: str | None = None) -> DataFrame:
    """Sum of sub-daily values per key and day, days without rows = 0, over each key's span
    (or the given closed date range; an end that is not given is the key's own)."""
    k = _k(keys)
    per_day = df.groupBy(*k, as_date(ts_col).alias("day")).agg(F.sum(value_col).alias("_s"))
    if start is not None or end is not None:
        bounds = per_day.groupBy(*k).agg(F.coalesce(F.lit(start).cast("date"), F.min("day")).alias("_lo"),
                                         F.coalesce(F.lit(end).cast("date"), F.max("day")).alias("_hi")).where("_lo <= _hi")
        grid = day_spine(bounds, k, "_lo", "_hi").join(per_day, k + ["day"], "left")
    else:
        grid = fill_days(per_day, k, "day")
    return grid.select(*k, "day", F.coalesce(F.col("_s"), F.lit(0.0)).alias(out))


# T9 ------------------------------------------------------------------------------------------
def annual_median(df: DataFrame, keys: Keys, date_col: str, value: Column | str, out: str = "median") -> DataFrame:
    """Median per key and calendar year, dense over each key's years (empty years NULL)."""
    k = _k(keys)
    v = F.col(value) if isinstance(value, str) else value
    per_year = df.groupBy(*k, year_bin(date_col).alias("period")).agg(F.median(v).alias(out))
    return densify_years(per_year, k)


# W3 ------------------------------------------------------------------------------------------
def end_window(df: DataFrame, keys: Keys, date_col: str, which: str, years: int) -> DataFrame:
    """Rows within the first or last ``years*365`` days of each key (both ends included)."""
    k = _k(keys)
    span = years * 365 - 1
    d = as_date(date_col)
    ext = key_extent(df, k, date_col, "_first", "_last")
    x = attach(df, ext, k)
    if which == "first":
        cond = d <= F.date_add(F.col("_first"), span)
    elif which == "last":
        cond = d >= F.date_sub(F.col("_last"), span)
    else:
        raise ValueError("which must be 'first' or 'last'")
    return x.where(cond).drop("_first", "_last")


# J14 -----------------------------------------------------------------------------------------
def lookup_date(df: DataFrame, keys: Keys, date_col: str, targets: DataFrame, target_col: str,
                method: str = "bfill", out: str = "found_date") -> DataFrame:
    """Per key, the first date >= target (bfill), last date <= target (ffill) or the
    nearest (ties to the earlier date).  ``targets`` has one row per key; no match gives NULL."""
    return lookup_dates(df, keys, date_col, targets, target_col, {out: method})


def lookup_dates(df: DataFrame, keys: Keys, date_col: str, targets: DataFrame, target_col: str,
                 methods: Mapping[str, str]) -> DataFrame:
    """J14 for several methods at once ({output column: 'bfill' | 'ffill' | 'nearest'}): one
    size-checked join of the targets onto the rows and one aggregation per key for all of them."""
    k = _k(keys)
    d = as_date(date_col)
    x = attach(df.select(*k, d.alias("_d")), targets.select(*k, F.col(target_col).cast("date").alias("_t")), k)
    aggs = []
    for out, method in methods.items():
        if method == "bfill":
            agg = F.min(F.when(F.col("_d") >= F.col("_t"), F.col("_d")))
        elif method == "ffill":
            agg = F.max(F.when(F.col("_d") <= F.col("_t"), F.col("_d")))
        elif method == "nearest":
            agg = F.min_by(F.col("_d"), F.struct(F.abs(F.datediff("_d", "_t")), F.col("_d")))
        else:
            raise ValueError("method must be bfill, ffill or nearest")
        aggs.append(agg.alias(out))
    found = x.groupBy(*k).agg(*aggs)
    return targets.join(found, k, "left")


# J10 -----------------------------------------------------------------------------------------
def neighbourhood(events: DataFrame, series: DataFrame, keys: Keys, event_date: str, date_col: str,
                  half_width_days: int = 183) -> DataFrame:
    """For each event, the rows of the same key within +-half_width days, with the event's date as
    ``event_date``.  An interval join on (key, time bucket): a hot key is spread over its buckets and
    an event meets only the rows of the one or two buckets that its window touches.  Events are few
    (flagged spikes): under the broadcast bound the rows are not shuffled at all."""
    k = _k(keys)
    day = as_date(event_date)
    ev = small_side(events.select(*k, day.alias("event_date"), F.date_sub(day, half_width_days).alias("_from"),
                                  F.date_add(day, half_width_days).alias("_to")))
    return interval_join(ev, series, k, "_from", "_to", date_col, base=2 * half_width_days + 1, one_width=True).drop("_from", "_to")
