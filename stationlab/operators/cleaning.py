"""Row-level cleaning rules and the exclusion rules that need per-key aggregates
(P2-P22, J5-J8, A8-A15).

Every rule is one projection or filter over the rows.  Rules that need a per-key or per-key-year
figure compute it with ``groupBy().agg()`` (partial aggregation) and attach it with a
size-checked broadcast, so the daily rows are never shuffled by key for cleaning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_date, keep_if, sentinel_to_null, true_or_false
from ..plans.physical import attach, materialize, small_side
from .stats import with_group_stats

Keys = Sequence[str]


def _k(keys: Keys | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# P1-P4 -----------------------------------------------------------------------------------------
def clean_sentinels(df: DataFrame, markers: Mapping[str, float], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """NULL where a value is close to its column's missing-value marker."""
    return df.withColumns({c: sentinel_to_null(c, s, rtol, atol) for c, s in markers.items()})


def recode(df: DataFrame, cols: Sequence[str], mapping: Mapping[int, int]) -> DataFrame:
    """Replace listed values in the listed columns (e.g. {10: 0} for parse errors)."""
    out = {}
    for c in cols:
        e = F.col(c)
        for old, new in mapping.items():
            e = F.when(F.col(c) == F.lit(old), F.lit(new).cast(df.schema[c].dataType)).otherwise(e)
        out[c] = e
    return df.withColumns(out)


def trim_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P4."""
    return df.withColumns({c: F.trim(c) for c in cols})


def in_region(country: str, state: str, lat: str, lon: str, us_states: Sequence[str], bounds_country: str,
              max_lat: float, max_lon: float, us_country: str = "US") -> Column:
    """P5: one OR filter instead of a UNION ALL of two filters over the same table (one scan):
    listed states of one country, or another country's stations inside lat/lon bounds."""
    a = (F.col(country) == F.lit(us_country)) & F.col(state).isin(list(us_states))
    b = (F.col(country) == F.lit(bounds_country)) & (F.col(lat) < F.lit(max_lat)) & (F.col(lon) < F.lit(max_lon))
    return true_or_false(a) | true_or_false(b)


# P9-P13, P16-P22 -------------------------------------------------------------------------------
def null_unless(df: DataFrame, cond: Column, cols: Sequence[str]) -> DataFrame:
    """Keep values where ``cond`` holds, NULL elsewhere."""
    return df.withColumns({c: keep_if(cond, c) for c in cols})


def zero_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P11."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in cols})


def year_bounds(start: str | None, end: str | None) -> tuple[str | None, str | None]:
    """Whole-year strings ('1974') widen to the year's first and last day, as a date slice does."""
    lo = f"{start}-01-01" if start and len(start) == 4 else start
    hi = f"{end}-12-31" if end and len(end) == 4 else end
    return lo, hi


def date_slice(df: DataFrame, date_col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= date <= end (both ends included; either end may be open)."""
    lo, hi = year_bounds(start, end)
    d = as_date(date_col)
    cond = F.lit(True)
    if lo:
        cond = cond & (d >= F.lit(lo).cast("date"))
    if hi:
        cond = cond & (d <= F.lit(hi).cast("date"))
    return df.where(cond)


def month_at_most(df: DataFrame, date_col: str, last_month: int) -> DataFrame:
    """P13."""
    return df.where(F.month(date_col) <= F.lit(last_month))


def seeded_pick(df: DataFrame, keys: Keys, seed: int) -> DataFrame:
    """One entity chosen by a seeded hash: the same under any partitioning or row order.  The
    smallest (hash, key) wins, so one row per task goes on."""
    k = _k(keys)
    return df.select(*k).distinct().orderBy(F.md5(F.concat_ws("|", F.lit(seed), *k)), *k).limit(1)


def jitter(df: DataFrame, value_col: str, seed: int, ids: Sequence[str], add: float = 0.005,
           mul: tuple[float, float] = (0.8, 1.2), out: str | None = None) -> DataFrame:
    """P20: additive U(-add, add) and multiplicative U(mul) noise.  The two draws of a row are digits of
    a hash of the seed and the row's ``ids``: the same noise under any partitioning, after a retry and
    in other engines.  Rows with equal ids get equal noise; a NULL id counts as absent."""
    h = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in ids]))
    u1, u2 = [F.conv(F.substring(h, i, 8), 16, 10).cast("double") / F.lit(4294967296.0) for i in (1, 9)]
    noisy = (F.col(value_col) + (u1 * F.lit(2 * add) - F.lit(add))) * (F.lit(mul[0]) + u2 * F.lit(mul[1] - mul[0]))
    return df.withColumn(out or value_col, noisy)


def drop_last_bin(df: DataFrame, keys: Keys, bin_col: str) -> DataFrame:
    """Drop each key's last (incomplete) bin; works on binned (aggregated) rows."""
    k = _k(keys)
    last = df.groupBy(*k).agg(F.max(bin_col).alias("_lastbin"))
    return df.join(last, k).where(F.col(bin_col) < F.col("_lastbin")).drop("_lastbin")


# J5 / J6 ---------------------------------------------------------------------------------------
def keep_keys(df: DataFrame, keys_df: DataFrame, keys: Keys) -> DataFrame:
    """Rows whose key is listed (left semi join; listed keys broadcast after a size check)."""
    k = _k(keys)
    return df.join(small_side(keys_df.select(*k).distinct()), k, "left_semi")


def missing_keys(df: DataFrame, keys_df: DataFrame, keys: Keys) -> DataFrame:
    """J5 strict: listed keys that have no rows (the reference raises on these)."""
    k = _k(keys)
    return keys_df.select(*k).distinct().join(df.select(*k), k, "left_anti")


def drop_keys(df: DataFrame, keys_df: DataFrame, keys: Keys) -> DataFrame:
    """Rows whose key is not listed (left anti join)."""
    k = _k(keys)
    return df.join(small_side(keys_df.select(*k).distinct()), k, "left_anti")


# J7 / J8 ---------------------------------------------------------------------------------------
def _point_flags(points: DataFrame, keys: Keys, points_date: str) -> DataFrame:
    return points.select(*_k(keys), as_date(points_date).alias("_d")).distinct().withColumn("_pt", F.lit(True))


def _year_flags(years: DataFrame, keys: Keys, year_col: str) -> DataFrame:
    return years.select(*_k(keys), F.col(year_col).cast("int").alias("_y")).distinct().withColumn("_yr", F.lit(True))


def null_at_points(df: DataFrame, points: DataFrame, keys: Keys, date_col: str, value_col: str,
                   points_date: str | None = None) -> DataFrame:
    """NULL the value at exact (key, date) points.  Repeated points do not repeat rows; points
    absent from the data are ignored."""
    k = _k(keys)
    x = df.withColumn("_d", as_date(date_col))
    x = attach(x, _point_flags(points, k, points_date or date_col), k + ["_d"], "left")
    return x.withColumn(value_col, F.when(F.col("_pt").isNull(), F.col(value_col))).drop("_d", "_pt")


def null_at_years(df: DataFrame, years: DataFrame, keys: Keys, date_col: str, value_col: str,
                  year_col: str = "year") -> DataFrame:
    """NULL the value for whole (key, calendar year) slices."""
    k = _k(keys)
    x = df.withColumn("_y", F.year(date_col))
    x = attach(x, _year_flags(years, k, year_col), k + ["_y"], "left")
    return x.withColumn(value_col, F.when(F.col("_yr").isNull(), F.col(value_col))).drop("_y", "_yr")


# A8 / A9 ---------------------------------------------------------------------------------------
def annual_sum_count(df: DataFrame, keys: Keys, date_col: str, value_col: str) -> DataFrame:
    """Sum and non-null count per key and calendar year; only years having rows; an all-NULL
    year sums to 0."""
    k = _k(keys)
    return df.groupBy(*k, F.year(date_col).alias("year")).agg(
        F.coalesce(F.sum(value_col), F.lit(0.0)).alias("annual_sum"), F.count(value_col).alias("annual_count"))


def implausible_years(df: DataFrame, keys: Keys, date_col: str, value_col: str, min_count: float = 365 * 0.9,
                      max_sum: float = 1.0) -> DataFrame:
    """(key, year) with at least ``min_count`` non-null values but a total under ``max_sum``."""
    a = annual_sum_count(df, keys, date_col, value_col)
    return a.where((F.col("annual_count") >= F.lit(min_count)) & (F.col("annual_sum") < F.lit(max_sum))) \
        .select(*_k(keys), "year")


def null_excluded(df: DataFrame, keys: Keys, date_col: str, value_col: str, points: DataFrame | None = None,
                  years: DataFrame | None = None, points_date: str | None = None, year_col: str = "year",
                  min_count: float = 365 * 0.9, max_sum: float = 1.0) -> DataFrame:
    """J7 + J8 + A9 in one pass: NULL the value where the (key, date) is a listed point, the
    (key, year) is a listed year, or the (key, year) is implausible.  All three sets are judged on
    the unmodified input, as the rules are defined."""
    k = _k(keys)
    flagged_years = implausible_years(df, k, date_col, value_col, min_count, max_sum).withColumnRenamed("year", "_y")
    if years is not None:
        flagged_years = flagged_years.unionByName(years.select(*k, F.col(year_col).cast("int").alias("_y")))
    flagged_years = flagged_years.distinct().withColumn("_yr", F.lit(True))
    x = df.withColumn("_y", F.year(date_col))
    x = attach(x, flagged_years, k + ["_y"], "left")
    cond = F.col("_yr").isNull()
    drop = ["_y", "_yr"]
    if points is not None:
        x = x.withColumn("_d", as_date(date_col))
        x = attach(x, _point_flags(points, k, points_date or date_col), k + ["_d"], "left")
        cond = cond & F.col("_pt").isNull()
        drop += ["_d", "_pt"]
    return x.withColumn(value_col, F.when(cond, F.col(value_col))).drop(*drop)


# A10 / A11 -------------------------------------------------------------------------------------
def gap_keys(df: DataFrame, keys: Keys, date_col: str, first_year: int = 1970, last_year: int = 1977,
             min_years: int | None = None) -> DataFrame:
    """A10: keys with rows in [first_year, last_year] but in fewer distinct years than the span
    has.  A year counts if it has any row, even one with all values NULL; keys without any row in
    the span are not flagged."""
    k = _k(keys)
    need = (last_year - first_year + 1) if min_years is None else min_years
    y = F.year(date_col)
    return (df.where((y >= F.lit(first_year)) & (y <= F.lit(last_year)))
              .groupBy(*k).agg(F.count_distinct(y).alias("years_present"))
              .where(F.col("years_present") < F.lit(need)))


def remove_before_if_gap(df: DataFrame, keys: Keys, date_col: str, cutoff: str = "1973-01-01",
                         first_year: int = 1970, last_year: int = 1977) -> DataFrame:
    """For keys flagged by :func:`gap_keys`, drop rows before ``cutoff``."""
    k = _k(keys)
    flags = gap_keys(df, k, date_col, first_year, last_year).select(*k).withColumn("_gap", F.lit(True))
    x = attach(df, flags, k, "left")
    keep = F.col("_gap").isNull() | (as_date(date_col) >= F.lit(cutoff).cast("date"))
    return x.where(keep).drop("_gap")


# A12-A14 ---------------------------------------------------------------------------------------
def _zscore_from_year_sums(per_year: DataFrame, key_list: DataFrame, k: list[str], year: int, min_rows: int,
                           guard_zero_std: bool = True) -> DataFrame:
    """A12 from (key, _yr, _s = Jan..last_month total, _rows = rows in those months) per year."""
    span = per_year.where((F.col("_yr") == F.lit(year)) & (F.col("_rows") > 0)) \
        .select(*k, F.col("_rows").alias("span_rows"), F.col("_s").alias("span_sum"))
    later = per_year.where((F.col("_yr") > F.lit(year)) & (F.col("_rows") > 0))
    bounds = later.groupBy(*k).agg(F.min("_yr").alias("_lo"), F.max("_yr").alias("_hi"))
    spine = bounds.select(*k, F.explode(F.sequence("_lo", "_hi")).alias("_yr"))
    dense = spine.join(later.select(*k, "_yr", "_s"), k + ["_yr"], "left").fillna({"_s": 0.0})
    stats = dense.groupBy(*k).agg(F.avg("_s").alias("later_mean"), F.stddev_samp("_s").alias("later_std"))
    per_key = key_list.join(span, k, "left").join(stats, k, "left").fillna({"span_rows": 0})
    ok = (F.col("span_rows") >= F.lit(min_rows)) & F.col("later_std").isNotNull()
    if guard_zero_std:
        ok = ok & (F.col("later_std") != 0)
    z = F.when(ok, F.try_divide(F.col("span_sum") - F.col("later_mean"), F.col("later_std")))
    return per_key.select(*k, "span_rows", "span_sum", "later_mean", "later_std", z.alias("zscore"))


def anomaly_zscore(df: DataFrame, keys: Keys, date_col: str, value_col: str, year: int = 1973, last_month: int = 5,
                   min_rows: int = 100, guard_zero_std: bool = True) -> DataFrame:
    """Z-score of one early span's total against the same months of every later year.

    span = year-01-01 .. end of ``last_month``; z = (span sum - mean) / sample std of the later
    yearly Jan..last_month sums.  Later years run from the first to the last later year having
    such rows; years in between without rows count as 0.  NULL when the span has fewer than
    ``min_rows`` rows (rows, not values), or the std is 0 (``guard_zero_std``) or undefined.
    One row per key of ``df``.

    The raw rows are read once: one aggregation gives each key's Jan..last_month total and row
    count per year (years before ``year`` share one bucket, so every key of ``df`` is present).
    That (key, year) table is checkpointed, and the span, the later years' bounds, the year spine,
    the standard deviation and the key list all come from it.
    """
    k = _k(keys)
    y = F.year(date_col)
    in_m = F.month(date_col) <= F.lit(last_month)
    yr = F.when(y >= F.lit(year), y).otherwise(F.lit(year - 1))
    per_year = materialize(df.groupBy(*k, yr.alias("_yr")).agg(
        F.coalesce(F.sum(F.when(in_m, F.col(value_col))), F.lit(0.0)).alias("_s"),
        F.count(F.when(in_m, F.lit(1))).alias("_rows")))
    return _zscore_from_year_sums(per_year, per_year.select(*k).distinct(), k, year, min_rows, guard_zero_std)


def remove_anomalous_span(df: DataFrame, keys: Keys, date_col: str, value_col: str, year: int = 1973,
                          last_month: int = 5, threshold: float = 5.0, min_rows: int = 100) -> DataFrame:
    """Drop the span's rows (not just values) for keys with z > threshold."""
    z = anomaly_zscore(df, keys, date_col, value_col, year, last_month, min_rows)
    bad = z.where(F.col("zscore") > F.lit(threshold))
    return drop_span_to_month_end(df, bad, keys, date_col, f"{year}-01-01", f"{year}-{last_month:02d}-01")


def drop_span_to_month_end(df: DataFrame, flagged: DataFrame, keys: Keys, date_col: str, start: str,
                           last_month_start: str) -> DataFrame:
    """P18 with the span's end at the last day of ``last_month_start``'s month."""
    k = _k(keys)
    flags = flagged.select(*k).distinct().withColumn("_flag", F.lit(True))
    x = attach(df, flags, k, "left")
    d = as_date(date_col)
    in_span = (d >= F.lit(start).cast("date")) & (d <= F.last_day(F.lit(last_month_start).cast("date")))
    return x.where(~(F.coalesce(F.col("_flag"), F.lit(False)) & in_span)).drop("_flag")


def zscore_review(df: DataFrame, keys: Keys, date_col: str, value_col: str, lo: float = 3.0, hi: float = 20.0,
                  **kw) -> DataFrame:
    """Unguarded z-scores (a zero std gives NULL, never inf/NaN) between lo and hi, for review."""
    z = anomaly_zscore(df, keys, date_col, value_col, guard_zero_std=False, **kw)
    return z.where((F.col("zscore") > F.lit(lo)) & (F.col("zscore") < F.lit(hi)))


# A15 -------------------------------------------------------------------------------------------
def ratio_flags(df: DataFrame, keys: Keys, date_col: str, value_col: str, threshold: float = 20.0,
                exclude_year: int | None = 1973, min_value: float | None = None) -> DataFrame:
    """Value / mean of the key's non-zero values (``exclude_year`` left out); rows with a ratio
    above ``threshold`` (and optionally value above ``min_value``).  The per-key mean is a
    partial aggregate attached back, not a window over the raw rows."""
    k = _k(keys)
    src = df if exclude_year is None else df.where(F.year(date_col) != F.lit(exclude_year))
    nz = F.nullif(F.col(value_col), F.lit(0.0))
    x = with_group_stats(src.withColumn("_nz", nz), k, {"key_mean": F.avg("_nz")})   # W1
    out = x.withColumn("ratio", F.try_divide(F.col("_nz"), F.col("key_mean"))).where(F.col("ratio") > F.lit(threshold))
    if min_value is not None:
        out = out.where(F.col(value_col) > F.lit(min_value))
    return out.drop("_nz")


# L4 + L5 in two passes -------------------------------------------------------------------------
def clean_dataset(df: DataFrame, keys: Keys, date_col: str, value_col: str, points: DataFrame | None = None,
                  years: DataFrame | None = None, dropped: DataFrame | None = None, points_date: str | None = None,
                  year_col: str = "year", min_count: float = 365 * 0.9, max_sum: float = 1.0,
                  z_year: int = 1973, z_last_month: int = 5, z_threshold: float = 5.0, z_min_rows: int = 100,
                  gap_first: int = 1970, gap_last: int = 1977, gap_cutoff: str = "1973-01-01") -> DataFrame:
    """The whole cleaning chain with two passes over the daily rows:

    drop listed keys (J6) -> NULL the value at listed points, in listed years and in implausible
    years judged on the input (J7, J8, A9) -> drop the early span of keys whose z-score on the
    nulled values exceeds the threshold (A12, A13) -> drop rows before the cutoff for keys with a
    gap in [gap_first, gap_last] counted after that removal (A10, A11).

    Pass 1 reduces the rows to one summary row per (key, year) -- non-null count and total of the
    input, the Jan..z_last_month total without the listed points, row counts -- from which
    every decision follows on small tables.  Pass 2 applies the decisions to the rows through a
    size-checked broadcast of the per-(key, year) decision table.  Same result as composing
    :func:`null_excluded`, :func:`remove_anomalous_span`, :func:`drop_keys` and
    :func:`remove_before_if_gap`, which re-read the rows once per rule.
    """
    k = _k(keys)
    x = df if dropped is None else drop_keys(df, dropped, k)
    x = x.withColumns({"_y": F.year(date_col), "_m": F.month(date_col), "_d": as_date(date_col)})
    if points is not None:
        x = attach(x, _point_flags(points, k, points_date or date_col), k + ["_d"], "left")
    else:
        x = x.withColumn("_pt", F.lit(None).cast("boolean"))
    v = F.col(value_col)
    in_m = F.col("_m") <= F.lit(z_last_month)
    at_pt = F.col("_pt").isNotNull()
    # pass 1: one row per (key, year)
    summary = x.groupBy(*k, "_y").agg(
        F.count(v).alias("n_values"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(in_m & ~at_pt, v)), F.lit(0.0)).alias("part_off_points"),
        F.count(F.when(in_m, F.lit(1))).alias("part_rows"),
        F.count(F.lit(1)).alias("rows"),
    )
    summary = materialize(summary)
    implausible = (F.col("n_values") >= F.lit(min_count)) & (F.col("total") < F.lit(max_sum))
    if years is not None:
        listed = _year_flags(years, k, year_col).withColumnRenamed("_yr", "_listed")
        summary = summary.join(listed, k + ["_y"], "left")
        null_year = implausible | F.col("_listed").isNotNull()
    else:
        null_year = implausible
    summary = summary.withColumn("null_year", null_year)
    # A12 on the nulled values: a nulled year sums to 0, listed points are left out of the sum (never
    # subtracted from it: the rounding residue would make equal years differ)
    nulled_part = F.when(F.col("null_year"), F.lit(0.0)).otherwise(F.col("part_off_points"))
    per_year = summary.where(F.col("_y") >= F.lit(z_year)).select(
        *k, F.col("_y").alias("_yr"), nulled_part.alias("_s"), F.col("part_rows").alias("_rows"))
    z = _zscore_from_year_sums(per_year, summary.select(*k).distinct(), k, z_year, z_min_rows)
    bad = z.where(F.col("zscore") > F.lit(z_threshold)).select(*k, F.lit(True).alias("anomalous"))
    # A10 after the span removal: a year counts if rows remain in it
    s2 = summary.join(bad, k, "left").withColumn("anomalous", F.coalesce("anomalous", F.lit(False)))
    left_rows = F.col("rows") - F.when(F.col("anomalous") & (F.col("_y") == F.lit(z_year)), F.col("part_rows")).otherwise(0)
    in_gap_span = (F.col("_y") >= F.lit(gap_first)) & (F.col("_y") <= F.lit(gap_last)) & (left_rows > 0)
    gaps = s2.groupBy(*k).agg(F.count(F.when(in_gap_span, F.lit(1))).alias("_years"),
                              F.max(F.when(in_gap_span, F.lit(1))).alias("_any")) \
        .where((F.col("_any") == 1) & (F.col("_years") < F.lit(gap_last - gap_first + 1))) \
        .select(*k, F.lit(True).alias("gap"))
    decisions = s2.join(gaps, k, "left").select(
        *k, "_y", "null_year", "anomalous", F.coalesce("gap", F.lit(False)).alias("gap"))
    # pass 2: apply the decisions
    y = attach(x, decisions, k + ["_y"], "left")
    null_here = F.coalesce(F.col("null_year"), F.lit(False)) | at_pt
    span_end = F.last_day(F.make_date(F.lit(z_year), F.lit(z_last_month), F.lit(1)))
    in_span = (F.col("_d") >= F.make_date(F.lit(z_year), F.lit(1), F.lit(1))) & (F.col("_d") <= span_end)
    drop = (F.coalesce(F.col("anomalous"), F.lit(False)) & in_span) | \
        (F.coalesce(F.col("gap"), F.lit(False)) & (F.col("_d") < F.lit(gap_cutoff).cast("date")))
    out = y.where(~drop).withColumn(value_col, F.when(~null_here, v))
    return out.select(*df.columns)
