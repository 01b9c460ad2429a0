"""Aggregations and statistics.

Everything is a ``groupBy().agg()`` with built-in aggregates, so Spark combines partial results
map-side before the shuffle.  Exact quantiles use ``percentile``, whose buffer holds one entry per
distinct value of the group (not per row); ``approx=True`` switches to ``percentile_approx`` for
continuous values on very large groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_date, days_between, safe_ratio, true_or_false
from ..plans.physical import attach
from .tiles import corr_matrix  # noqa: F401  (A32)
from .timeseries import year_bin
from .timeseries import densify_years

Keys = Sequence[str]


def _k(keys: Keys | str | None) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


# A1 / A2 -------------------------------------------------------------------------------------
def extent(df: DataFrame, keys: Keys, date_col: str) -> DataFrame:
    """A1: first date, last date and row count per key."""
    d = as_date(date_col)
    return df.groupBy(*_k(keys)).agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"),
                                     F.count(F.lit(1)).alias("record_count"))


def coverage(first: str = "first_date", last: str = "last_date", count: str = "record_count",
             inclusive: bool = True) -> Column:
    """A2: rows / calendar days spanned.  ``inclusive`` counts both end days (a one-day station
    gives 1.0); without it a one-day station divides by zero and gives NULL."""
    days = days_between(first, last) + (F.lit(1) if inclusive else F.lit(0))
    return safe_ratio(count, days)


def extent_coverage(df: DataFrame, keys: Keys, date_col: str, inclusive: bool = True) -> DataFrame:
    return extent(df, keys, date_col).withColumn("time_coverage", coverage(inclusive=inclusive))


# A3 / A5 -------------------------------------------------------------------------------------
def duration_years(start: str, end: str) -> Column:
    """A5: whole days / 365.25."""
    return days_between(start, end).cast("double") / F.lit(365.25)


def nominal_vs_actual(df: DataFrame, nominal_begin: str, nominal_end: str, first: str = "first_date",
                      last: str = "last_date") -> DataFrame:
    """A3: nominal and actual durations (days) and the day differences of begin, end, duration."""
    return df.withColumns({
        "nominal_days": days_between(nominal_begin, nominal_end),
        "actual_days": days_between(first, last),
        "begin_diff_days": days_between(nominal_begin, first),
        "end_diff_days": days_between(nominal_end, last),
    }).withColumn("duration_diff_days", F.col("actual_days") - F.col("nominal_days"))


def cap_end_date(end_col: str, cutoff: str, replacement: Column) -> Column:
    """P10: keep the end date where it is before ``cutoff``, else ``replacement`` (NULL ends too)."""
    return F.when(true_or_false(F.col(end_col) < F.lit(cutoff).cast("date")), F.col(end_col)).otherwise(replacement)


# A4 / A24 ------------------------------------------------------------------------------------
def fraction(cond: Column) -> Column:
    """A4: share of rows where ``cond`` holds; NULL counts as not passing and stays in the denominator."""
    return F.avg(true_or_false(cond).cast("double"))


def fraction_by(df: DataFrame, by: Keys | None, conds: Mapping[str, Column]) -> DataFrame:
    """Several threshold shares at once, over the whole table or per group."""
    aggs = [fraction(c).alias(n) for n, c in conds.items()]
    return df.groupBy(*_k(by)).agg(*aggs)


# A6 / A7 -------------------------------------------------------------------------------------
STAT_FUNCS = {
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "std": F.stddev_samp,
}


def annual_stats(df: DataFrame, keys: Keys, date_col: str, value_cols: Sequence[str],
                 stats: Sequence[str] = ("mean", "max", "min", "std"), sum_cols: Sequence[str] = (),
                 count_cols: Sequence[str] = (), dense: bool = True) -> DataFrame:
    """Per key and calendar year, ``{stat}_{col}`` for every value column, ``sum_{col}`` and
    ``count_{col}`` (non-null).  With ``dense`` the years between a key's first and last year that
    have no rows are emitted too: NULL stats, 0 sums and counts.

    The year spine is built from the aggregated (key, year) table, so the raw rows are shuffled
    once, as partial aggregates.
    """
    k = _k(keys)
    aggs = [STAT_FUNCS[s](c).alias(f"{s}_{c}") for c in value_cols for s in stats]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in sum_cols]
    aggs += [F.count(c).alias(f"count_{c}") for c in count_cols]
    per_year = df.groupBy(*k, year_bin(date_col).alias("period")).agg(*aggs)
    if not dense:
        return per_year
    fill = {f"sum_{c}": 0 for c in sum_cols}
    fill.update({f"count_{c}": 0 for c in count_cols})
    return densify_years(per_year, k, "period", fill)


def coverage_flag(count_col: str, days: float = 365.0, share: float = 0.9) -> Column:
    """Non-null count above ``days * share`` (328.5 by default)."""
    return F.col(count_col) > F.lit(days * share)


# A16 / A21 -----------------------------------------------------------------------------------
def _quantile(c: Column, p: float, approx: bool) -> Column:
    return F.percentile_approx(c, p, 100000) if approx else F.percentile(c, F.lit(p))


def describe(df: DataFrame, value_cols: Sequence[str], by: Keys | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, std, min, 25/50/75 % (linear interpolation), max per column; long form
    with one row per (group, column).  One aggregation computes every column's figures (one
    pass over the rows, whatever the number of columns); the row per column comes from exploding
    an array of per-column structs on the aggregated rows."""
    k = _k(by)
    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    aggs = []
    for i, c in enumerate(value_cols):
        v = F.col(c).cast("double")
        figs = [F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), _quantile(v, 0.25, approx),
                _quantile(v, 0.5, approx), _quantile(v, 0.75, approx), F.max(v)]
        aggs += [f.alias(f"_{i}_{n}") for f, n in zip(figs, names)]
    wide = df.groupBy(*k).agg(*aggs)
    per_col = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"_{i}_{n}").alias(n) for n in names])
                        for i, c in enumerate(value_cols)])
    return wide.select(*k, F.inline(per_col))


def median(df: DataFrame, value_col: str, by: Keys | None = None, out: str = "median") -> DataFrame:
    """A21."""
    return df.groupBy(*_k(by)).agg(F.median(value_col).alias(out))


# A17 / A18 -----------------------------------------------------------------------------------
def value_counts(df: DataFrame, cols: Sequence[str] | str, by: Keys | None = None, dropna: bool = True,
                 normalize: bool = False) -> DataFrame:
    """Frequency of each value (combination) per group; NULL is its own value unless dropped.
    ``normalize`` adds the share within the group.  The number of distinct values is not bounded,
    so the group total is not a window (that would put a group's, or with no groups all, distinct
    values in one task): it is a one-row scalar subquery, or per-group totals joined back with a
    size-checked broadcast."""
    cs = _k(cols)
    k = _k(by)
    src = df.dropna(subset=cs) if dropna else df
    out = src.groupBy(*k, *cs).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        if not k:
            return out.withColumn("share", F.col("count") / out.agg(F.sum("count")).scalar())
        totals = src.groupBy(*k).agg(F.count(F.lit(1)).alias("_total"))
        out = attach(out, totals, k).withColumn("share", F.col("count") / F.col("_total")).drop("_total")
    return out


def describe_text(df: DataFrame, col_name: str, by: Keys | None = None) -> DataFrame:
    """Non-null count, distinct count, most frequent value (ties: smallest value) and its count."""
    k = _k(by)
    vc = value_counts(df, col_name, k, dropna=True)
    return vc.groupBy(*k).agg(
        F.sum("count").alias("n_values"),
        F.count(F.lit(1)).alias("n_unique"),
        F.min_by(col_name, F.struct(-F.col("count"), F.col(col_name))).alias("top"),
        F.max("count").alias("freq"),
    )


# A19 / A20 -----------------------------------------------------------------------------------
def null_profile(df: DataFrame, cols: Sequence[str], by: Keys | None = None) -> DataFrame:
    """Rows, null count and null share per column (long form, one ``agg`` for all columns)."""
    k = _k(by)
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(c).alias(f"_nn_{c}") for c in cols]
    wide = df.groupBy(*k).agg(*aggs)
    long = wide.unpivot([*k, "_rows"], [f"_nn_{c}" for c in cols], "_col", "non_null")
    return long.select(
        *k, F.regexp_replace("_col", "^_nn_", "").alias("column_name"), F.col("_rows").alias("n_rows"),
        (F.col("_rows") - F.col("non_null")).alias("null_count"),
        safe_ratio(F.col("_rows") - F.col("non_null"), "_rows").alias("null_share"),
    )


def column_maxima(df: DataFrame, cols: Sequence[str], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """The maximum of each column, plus any ``extra`` named aggregates, in one pass."""
    return df.agg(*[F.max(c).alias(f"max_{c}") for c in cols], *[c.alias(n) for n, c in (extra or {}).items()])


# A22 / A23 -----------------------------------------------------------------------------------
def histogram(df: DataFrame, value: Column | str, bins: int, lo: float | None = None, hi: float | None = None,
              by: Keys | None = None, density: bool = False, log10: bool = False, zero_to_null: bool = False,
              dense: bool = True) -> DataFrame:
    """Equal-width bins over [lo, hi] (or the data's min..max, a one-row aggregate fetched as
    two literals); the last bin is closed on the right; values outside and NULLs are dropped.
    Output: (group, bin, bin_lo, bin_hi, count[, density])."""
    k = _k(by)
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    if zero_to_null:
        v = F.nullif(v, F.lit(0.0))
    if log10:
        v = F.when(v > 0, F.log10(v))
    x = df.select(*k, v.alias("_v")).where(F.col("_v").isNotNull())
    if lo is None or hi is None:
        mn, mx = x.agg(F.min("_v"), F.max("_v")).first()
        lo = mn if lo is None else lo
        hi = mx if hi is None else hi
    if lo is None:  # no values at all
        return x.select(*k, F.lit(0).alias("bin"), F.lit(0.0).alias("bin_lo"), F.lit(0.0).alias("bin_hi"),
                        F.lit(0).cast("bigint").alias("count")).limit(0)
    lo, hi = float(lo), float(hi)
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col("_v") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    # the quotient may be rounded across an edge: a value belongs to the bin whose edges hold it
    below = F.col("_v") < F.lit(lo) + b * F.lit(width)
    above = (F.col("_v") >= F.lit(lo) + (b + 1) * F.lit(width)) & (b < bins - 1)
    b = F.when(below, b - 1).when(above, b + 1).otherwise(b)
    inside = (F.col("_v") >= F.lit(lo)) & (F.col("_v") <= F.lit(hi))
    counts = x.where(inside).groupBy(*k, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    if dense:
        # one row per group: its bin -> count map (at most ``bins`` entries) and total, exploded
        # over every bin -- no group list and no spine join (a distinct of the groups would be
        # planned as a second scan of the raw rows)
        per = counts.groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_m"),
                                     F.sum("count").alias("_tot"))
        counts = per.select(*k, "_m", "_tot", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")) \
            .withColumn("count", F.coalesce(F.try_element_at(F.col("_m"), F.col("bin")), F.lit(0)).cast("bigint"))
        total = F.col("_tot")
    else:
        w = Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0))   # at most ``bins`` rows a group
        total = F.sum("count").over(w)
    out = counts.withColumns({
        "bin_lo": F.lit(lo) + F.col("bin") * F.lit(width),
        "bin_hi": F.lit(lo) + (F.col("bin") + 1) * F.lit(width),
    })
    if density:
        out = out.withColumn("density", F.try_divide(F.col("count"), total * F.lit(width)))
    return out.select(*k, "bin", "bin_lo", "bin_hi", "count", *(["density"] if density else []))


def ecdf(df: DataFrame, value: Column | str, bins: int = 100, lo: float | None = None, hi: float | None = None,
         by: Keys | None = None, log10: bool = False) -> DataFrame:
    """Cumulative share over equal-width bins, per group.  The running sum is a window over
    the aggregated bins (at most ``bins`` rows per group), never over raw rows."""
    k = _k(by)
    v = F.col(value) if isinstance(value, str) else value
    if log10:
        v = F.when(v.cast("double") == 0, F.lit(0.001)).otherwise(v.cast("double"))
    h = histogram(df, v, bins, lo, hi, by=k, log10=log10)
    wk = Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0))
    run = wk.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return h.withColumn("cum_share", safe_ratio(F.sum("count").over(run), F.sum("count").over(wk)))


# A25-A29 -------------------------------------------------------------------------------------
def group_stats(df: DataFrame, by: Keys, aggs: Mapping[str, Column]) -> DataFrame:
    """Named aggregates per group (mean by category, count/min/max per key, ...).
    J13 (several results on the same key side by side) is this with several entries in ``aggs``:
    one aggregation, no join between per-result tables."""
    return df.groupBy(*_k(by)).agg(*[c.alias(n) for n, c in aggs.items()])


def with_group_stats(df: DataFrame, by: Keys, aggs: Mapping[str, Column]) -> DataFrame:
    """Group aggregates copied to every row of the group (``mean(x) over (partition by key)``).

    Computed as a partial aggregate per group attached back with a size-checked broadcast join,
    not as a window: a window over the raw rows would send a hot group's rows to one task, while
    the aggregate sends one partial row per group and partition to the shuffle."""
    return attach(df, group_stats(df, by, aggs), _k(by), "left")


def distinct_count(df: DataFrame, cols: Sequence[str], by: Keys | None = None) -> DataFrame:
    """Exact distinct count of each column (per group)."""
    return df.groupBy(*_k(by)).agg(*[F.count_distinct(c).alias(f"distinct_{c}") for c in cols])


def best_per_group(df: DataFrame, by: Keys, value: str, out: str = "best") -> DataFrame:
    """Maximum of a value per group."""
    return df.groupBy(*_k(by)).agg(F.max(value).alias(out))


# A30-A33, A35 --------------------------------------------------------------------------------
def center_on(df: DataFrame, group: Keys, period_col: str, value_col: str, base, out: str = "centered") -> DataFrame:
    """Subtract each group's value at the base period; NULL where the group lacks it.
    The base values are one row per group, aggregated and joined back (no raw-row window)."""
    g = _k(group)
    base_vals = df.where(F.col(period_col) == F.lit(base)).groupBy(*g).agg(F.max(value_col).alias("_base"))
    return df.join(base_vals, g, "left").withColumn(out, F.col(value_col) - F.col("_base")).drop("_base")


def linear_trend(df: DataFrame, group: Keys, x: str, y: str) -> DataFrame:
    """OLS slope and intercept per group; rows with a NULL x or y are skipped."""
    return df.groupBy(*_k(group)).agg(
        F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
        F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
        F.regr_count(F.col(y).cast("double"), F.col(x).cast("double")).alias("n_points"),
    )


def normalise_by_max(df: DataFrame, group: Keys, value_col: str, out: str = "normalised") -> DataFrame:
    """Value / its group's maximum (group maxima aggregated and joined back)."""
    g = _k(group)
    mx = df.groupBy(*g).agg(F.max(value_col).alias("_mx"))
    return df.join(mx, g, "left").withColumn(out, safe_ratio(value_col, "_mx")).drop("_mx")


# A36 / A37 / O3 ------------------------------------------------------------------------------
def row_at_max(df: DataFrame, value_col: str, by: Keys | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The whole row at the maximum value (per group); ties go to the smallest tiebreak."""
    k = _k(by)
    others = [c for c in df.columns if c not in k]
    v, ties = F.col(value_col), [F.col(t) for t in tiebreak]
    row = F.struct(*others)
    if _numeric(df, value_col):
        best = F.min_by(row, F.struct(v.isNull().alias("none"), (-v).alias("value"), *ties))
    elif not ties:
        best = F.coalesce(F.max_by(row, v), F.min_by(row, v.isNull()))
    else:
        # dates and text have no negative: the first row by tiebreak per value, then the row of the largest value
        # (a NULL value comes last); one row per (group, value) goes on
        per = df.groupBy(*k, v.alias("_value")).agg(F.min_by(row, F.struct(*ties)).alias("_r"))
        return per.groupBy(*k).agg(F.coalesce(F.max_by("_r", "_value"), F.first("_r")).alias("_r")).select(*k, "_r.*")
    return df.groupBy(*k).agg(best.alias("_r")).select(*k, "_r.*")


def _numeric(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("integer", "long", "short", "byte", "double", "float")


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows minus distinct key combinations (0 means the key is unique)."""
    return df.agg((F.count(F.lit(1)) - F.count_distinct(*keys)).alias("duplicate_rows"))


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: Keys | None = None) -> DataFrame:
    """O3: the k first rows by ``order``; per group with ``row_number() <= k``, which Spark plans
    with a WindowGroupLimit that prunes each partition before the shuffle.  (O1/O2, plain sorts,
    and O4, first rows, are ``orderBy`` and ``limit`` at the sink: sorting an intermediate result
    would only add a shuffle.)"""
    g = _k(by)
    if not g:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*g).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


# V1 / V2 ---------------------------------------------------------------------------------------
def pivot_wide(df: DataFrame, index: Keys, column: str, value: Column, values: Sequence | None = None,
               prefix: str = "") -> DataFrame:
    """V1: long -> wide with one column per value of ``column``.  Pass ``values`` when known;
    otherwise the distinct values are fetched once (a pivot needs its columns before planning),
    at most ``spark.sql.pivotMaxValues`` of them (Spark's own limit on pivot width): a column
    with more values is not a pivot and raises instead of pulling an unbounded list."""
    if values is None:
        cap = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
        got = [r[0] for r in df.select(column).distinct().limit(cap + 1).collect()]
        if len(got) > cap:
            raise ValueError(f"{column} has more than {cap} distinct values; pass values= or use long form")
        values = sorted(got, key=lambda v: (v is None, v))
    wide = df.groupBy(*_k(index)).pivot(column, list(values)).agg(value)
    return wide.select(*_k(index), *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def unpivot_long(df: DataFrame, index: Keys, value_cols: Sequence[str], name_col: str = "variable",
                 value_col: str = "value") -> DataFrame:
    """V2: wide -> long."""
    return df.unpivot(_k(index), list(value_cols), name_col, value_col)
