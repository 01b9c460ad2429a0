"""User entry points (L1-L13): the operators composed the way the daily-station workflow uses
them.  Every function returns lazy DataFrames; nothing is collected except the bounded lookups
documented on the operators (city list, pivot values)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import below_flag, daily_spread
from ..operators import cleaning as C
from ..operators import continuity as SP
from ..operators import quality as Q
from ..operators import stats as A
from ..operators import stations as ST
from ..operators import timeseries as TS
from ..sources import readers as R

KEY = S.KEY
DATE = S.DATE
PRECIP = "precipitation_total_inches"

# The member states and the bounds used to pick the stations of the study area.
STUDY_STATES = ["WA", "OR", "CA", "ID", "NV", "AZ", "MT", "WY", "UT", "CO", "NM"]
STUDY_BOUNDS = {"country": "CA", "max_lat": 60.0, "max_lon": -110.0}


# L1 --------------------------------------------------------------------------------------------
def clean_daily(raw: DataFrame) -> DataFrame:
    """P2 + P3 on an already-typed daily table."""
    present = {c: s for c, s in S.MISSING_MARKERS.items() if c in raw.columns}
    out = C.clean_sentinels(raw, present)
    recode = [c for c in S.RECODE_TEN_TO_ZERO if c in raw.columns]
    return C.recode(out, recode, {10: 0}) if recode else out


def get_daily(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """L1: read the daily export, then missing markers -> NULL and indicator recodes."""
    return clean_daily(R.read_daily(spark, path))


# L2 --------------------------------------------------------------------------------------------
def station_metadata(stations: DataFrame, cities: DataFrame) -> DataFrame:
    """L2: stations with their nearest city and its distance (names already trimmed on read)."""
    return ST.nearest_city(stations, cities, keys=KEY)


# L3 --------------------------------------------------------------------------------------------
def get_subset(daily: DataFrame, selected: DataFrame, columns: Sequence[str] = tuple(S.PANEL_COLUMNS)) -> DataFrame:
    """L3: the listed stations' rows, projected to key, date and the panel columns."""
    return C.keep_keys(daily, selected, KEY).select(*KEY, DATE, *columns)


# L4 --------------------------------------------------------------------------------------------
def clean_precip(panel: DataFrame, points: DataFrame | None = None, years: DataFrame | None = None,
                 value_col: str = PRECIP, zscore_threshold: float = 5.0) -> DataFrame:
    """L4: NULL precipitation at listed points, in listed years and in implausible years (all three
    judged on the input), then drop the anomalous early span found on the nulled values."""
    x = C.null_excluded(panel, KEY, DATE, value_col, points=points, years=years)
    return C.remove_anomalous_span(x, KEY, DATE, value_col, 1973, 5, threshold=zscore_threshold)


# L5 --------------------------------------------------------------------------------------------
def make_dataset(daily: DataFrame, selected: DataFrame, points: DataFrame | None = None,
                 years: DataFrame | None = None, dropped: DataFrame | None = None) -> DataFrame:
    """Subset -> (drop listed stations) -> precipitation cleaning -> early-gap rule.
    Dropping first reads less; all cleaning rules are per key, so the order does not change the
    result.  Runs as :func:`stationlab.operators.cleaning.clean_dataset`: two passes over the
    daily rows (one per-(key, year) summary deciding every rule, then applying the decisions)
    instead of one pass per rule; tests hold it equal to the rule-by-rule chain."""
    x = get_subset(daily, selected)
    return C.clean_dataset(x, KEY, DATE, PRECIP, points=points, years=years, dropped=dropped)


# L6 --------------------------------------------------------------------------------------------
def candidate_stations(stations: DataFrame, cities: DataFrame, max_km: float = 50.0, min_years: float = 10.0,
                       inclusive: bool = True) -> DataFrame:
    """Stations of the study area (one OR filter), near a city and long enough on paper."""
    area = stations.where(C.in_region("country", "state", "latitude", "longitude", STUDY_STATES,
                                      STUDY_BOUNDS["country"], STUDY_BOUNDS["max_lat"], STUDY_BOUNDS["max_lon"]))
    area = area.withColumn("duration_years", A.duration_years("nominal_begin_date", "nominal_end_date"))
    near = station_metadata(area, cities)
    return ST.near_and_long(near, max_km, min_years, inclusive=inclusive) \
        .withColumn("duration_years", F.bround("duration_years", 2))


# L7 --------------------------------------------------------------------------------------------
def nominal_agreement(daily: DataFrame, stations: DataFrame, last_year: int = 2022,
                      cutoff: str = "2021-09-01") -> DataFrame:
    """A1 + A3 + P10 + Q6: per station its nominal span beside its actual one.  ``operating``: the last row
    falls in ``last_year``; ``modified_end``: a nominal end before ``cutoff`` stays, any other (NULL too) is
    the last day of the whole table; ``modified_diff_days``: the nominal span so repaired minus the actual one.
    Stations without rows have no actual span and are left out."""
    ext = A.extent(daily, KEY, DATE)
    x = A.nominal_vs_actual(ext.join(stations, KEY), "nominal_begin_date", "nominal_end_date")
    last_of_all = ext.agg(F.max("last_date")).scalar()
    x = x.withColumns({"operating": F.year("last_date") == F.lit(last_year),
                       "modified_end": A.cap_end_date("nominal_end_date", cutoff, last_of_all)})
    return x.withColumn("modified_diff_days", F.date_diff("modified_end", "nominal_begin_date") - F.col("actual_days"))


def agreement_shares(agreement: DataFrame) -> DataFrame:
    """A4 + A21, per ``operating``: the number of stations, the median end difference, and the shares whose dates
    are off by more than a week, a year or five (a NULL difference is not off and stays in the denominator)."""
    x = A.with_group_stats(agreement, ["operating"], {"median_end_diff": F.median("end_diff_days")})
    off = {"begin_off_7": F.abs("begin_diff_days") > 7, "end_off_7": F.abs("end_diff_days") > 7,
           "end_off_7_from_median": F.abs(F.col("end_diff_days") - F.col("median_end_diff")) > 7,
           "duration_off_7": F.abs("modified_diff_days") > 7, "duration_off_365": F.abs("modified_diff_days") > 365,
           "duration_off_1825": F.abs("modified_diff_days") > 5 * 365}
    return A.group_stats(x, ["operating"], {"n_stations": F.count(F.lit(1)), "median_end_diff": F.max("median_end_diff"),
                                            **{n: A.fraction(c) for n, c in off.items()}})


def coverage_shares(coverage: DataFrame, cover_col: str, limits: Sequence[float] = (0.9, 0.8)) -> DataFrame:
    """A4: the shares of stations whose coverage reaches each limit (NULL coverage does not), in one row."""
    return A.fraction_by(coverage, None, {f"from_{round(100 * x)}_pct": F.col(cover_col) >= F.lit(x) for x in limits})


def quality_report(daily: DataFrame, stations: DataFrame | None = None, last_year: int = 2022,
                   cutoff: str = "2021-09-01") -> dict[str, DataFrame]:
    """The data-quality tables: extents and coverage with their shares and histogram, nominal vs actual
    dates with repaired ends, null profile, cross-field rules, pressure rule by flag, sample-count resolution,
    filtered coverage, histograms of the readings, duplicates, indicator counts and profile."""
    value_cols = [c for c in S.MISSING_MARKERS if c in daily.columns]
    ext = A.extent_coverage(daily, KEY, DATE)
    out = {
        "extent": ext,
        "coverage_shares": coverage_shares(ext, "time_coverage"),
        "coverage_hist": A.histogram(ext, "time_coverage", 20, 0.0, 1.0),
        "null_profile": A.null_profile(daily, value_cols),
        "maxima": A.column_maxima(daily, value_cols),
        "duplicates": A.duplicate_count(daily, KEY + [DATE]),
        "cross_field": Q.rule_violations(daily, {
            "min_gt_mean": F.col("temp_f_min") > F.col("temp_f_mean"),
            "mean_gt_max": F.col("temp_f_mean") > F.col("temp_f_max"),
            "mean_lt_dew_point": F.col("temp_f_mean") < F.col("dew_point_f_mean"),
        }),
    }
    if {"sea_level_pressure_mbar_mean", "pressure_mbar_mean"} <= set(daily.columns):
        valid = daily.where(~C.true_or_false(F.col("pressure_mbar_mean") < 200))
        out["pressure_rule"] = A.value_counts(
            valid.withColumn("sea_below_station", F.col("sea_level_pressure_mbar_mean") < F.col("pressure_mbar_mean")),
            ["sea_below_station"], dropna=False)
    if "temp_count" in daily.columns:
        out["resolution"] = Q.resolution_profile(daily, KEY, "temp_count")
        kept = Q.filtered_coverage(daily, KEY, DATE, "temp_f_mean", "temp_count", 20)
        share = kept.columns[-1]
        out["filtered_coverage"] = kept
        out["filtered_shares"] = coverage_shares(kept, share)
        out["filtered_hist"] = A.histogram(kept, share, 20, 0.0, 1.0)
    for c in ("temp_f_mean", "temp_f_min", "temp_f_max"):
        if c in daily.columns:
            out[f"{c}_hist"] = A.histogram(daily, c, 100)
    if PRECIP in daily.columns:
        out["precip_log_hist"] = A.histogram(daily, PRECIP, 50, log10=True, zero_to_null=True)
    flags = [c for c in ("had_rain", "had_snow_ice", "had_hail") if c in daily.columns]
    if flags and PRECIP in daily.columns:
        out["indicator_counts"] = A.value_counts(daily, flags, dropna=False)
        out["precip_by_indicator"] = Q.indicator_profile(daily, Q.any_of(flags), PRECIP)
    if stations is not None:
        agreement = nominal_agreement(daily, stations, last_year, cutoff)
        out["nominal_vs_actual"] = agreement
        out["agreement_shares"] = agreement_shares(agreement)
        out["duration_diff_hist"] = A.histogram(agreement, "modified_diff_days", 30, -365, 365, by=["operating"])
        out["operating"] = Q.last_year_is(daily, KEY, DATE, last_year)
    return out


# L8 --------------------------------------------------------------------------------------------
def shortlist(daily: DataFrame, station_meta: DataFrame, threshold_years: float = 3.0,
              threshold_date: str = "1900-01-01", prefixes: DataFrame | None = None,
              not_named: Sequence[str] = ()) -> DataFrame:
    """Stations with more than threshold_years * 0.8 * 365.25 rows or data before the date,
    with coverage and the station facts attached.  ``prefixes`` (column ``prefix``) keeps the stations whose
    trimmed name starts with one of them; ``not_named`` drops false positives by their whole name."""
    ext = A.extent(daily, KEY, DATE)
    keep = (F.col("record_count") > F.lit(threshold_years * 0.8 * 365.25)) | \
        (F.col("first_date") < F.lit(threshold_date).cast("date"))
    ext = ext.where(keep).withColumn("time_coverage", A.coverage())
    out = ext.join(station_meta, KEY, "left")
    if prefixes is not None:
        out = ST.prefix_match(out, "name", prefixes)
    return out.where(~C.true_or_false(F.col("name").isin(list(not_named)))) if not_named else out


def shortlist_periods(daily: DataFrame, shortlisted: DataFrame, value_col: str = "temp_f_mean",
                      months: int = 12) -> DataFrame:
    """Days with a value per 12-month period of each shortlisted station, counted from the month of its
    first row; periods without a value are left out."""
    facts = shortlisted.select(*KEY, "name", "nearest_city")
    binned = TS.anchored_month_bins(C.keep_keys(daily, shortlisted.select(*KEY), KEY), KEY, DATE, months)
    counts = binned.groupBy(*KEY, "period_start", "period_end").agg(F.count(value_col).alias("count_days"))
    return counts.where(F.col("count_days") > 0).join(facts, KEY)


# L9 --------------------------------------------------------------------------------------------
ANNUAL_COLS = ["temp_f_mean", "temp_f_max", "temp_f_min", "daily_temp_spread", PRECIP]


def annual_summary(panel: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Derived columns -> dense annual stats -> station facts -> zero precip stats to NULL ->
    coverage flags."""
    x = panel.withColumns({"daily_temp_spread": daily_spread("temp_f_max", "temp_f_min"),
                           "reached_freezing": below_flag("temp_f_min", 32.0)})
    a = A.annual_stats(x, KEY, DATE, ANNUAL_COLS, sum_cols=["reached_freezing"], count_cols=["temp_f_mean", PRECIP])
    if meta is not None:
        a = a.join(meta.select(*KEY, "nearest_city", "name"), KEY)
    a = C.zero_to_null(a, [f"mean_{PRECIP}", f"max_{PRECIP}"])
    return a.withColumns({"good_temp_coverage": A.coverage_flag("count_temp_f_mean"),
                          "good_precip_coverage": A.coverage_flag(f"count_{PRECIP}")})


# L10 -------------------------------------------------------------------------------------------
def city_trends(annual: DataFrame, base_period: str = "1980-01-01") -> dict[str, DataFrame]:
    """City-year means of quality-passed station means, centred on a base year, their
    correlation matrix and linear trends."""
    a = annual.withColumn("qc_temp", F.when(F.col("good_temp_coverage"), F.col("mean_temp_f_mean")))
    city = a.groupBy("nearest_city", "period").agg(F.avg("qc_temp").alias("qc_temp")) \
        .withColumn("year", F.year("period"))
    return {
        "city_year": city,
        "centered": A.center_on(city, ["nearest_city"], "period", "qc_temp", base_period),
        "corr": A.corr_matrix(city, "nearest_city", "period", "qc_temp"),
        "trend": A.linear_trend(city, ["nearest_city"], "year", "qc_temp"),
    }


# L11 -------------------------------------------------------------------------------------------
def splice_report(daily: DataFrame, groups: DataFrame, value_cols: Sequence[str] = ("temp_f_mean", "temp_f_max",
                  "temp_f_min", "daily_temp_spread"), window_years: int = 10, n_samples: int = 2000,
                  quantiles: Sequence[float] = (0.025, 0.5, 0.975), seed: int = 0) -> DataFrame:
    """Bootstrap confidence intervals of the shift across each splice, all pairs at once."""
    x = daily
    if "daily_temp_spread" in value_cols and "daily_temp_spread" not in daily.columns:
        x = daily.withColumn("daily_temp_spread", daily_spread("temp_f_max", "temp_f_min"))
    return SP.splice_report(x, groups, KEY, DATE, list(value_cols), window_years, n_samples, quantiles, seed)


# L12 -------------------------------------------------------------------------------------------
def clean_annual_precip(clean_panel: DataFrame, meta: DataFrame, min_count: float = 365 * 0.9,
                        min_total: float = 1.0) -> DataFrame:
    """Annual totals kept only for well-covered, plausible years, one column per station name
    (name and key where several stations share a name)."""
    a = C.annual_sum_count(clean_panel, KEY, DATE, PRECIP)
    ok = (F.col("annual_count") >= F.lit(min_count)) & (F.col("annual_sum") >= F.lit(min_total))
    a = a.withColumn("annual_sum", F.when(ok, F.col("annual_sum"))).join(_column_names(meta), KEY)
    return A.pivot_wide(a, ["year"], "name", F.first("annual_sum", ignorenulls=True))


def _column_names(meta: DataFrame) -> DataFrame:
    """One column name per station key."""
    stations = meta.select(*KEY, "name").dropDuplicates(KEY)
    shared = stations.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    label = F.when(F.col("_n") > 1, F.concat_ws(" ", "name", F.concat(F.lit("("), F.concat_ws(" ", *KEY), F.lit(")")))) \
        .otherwise(F.col("name"))
    return stations.join(shared, "name").select(*KEY, label.alias("name"))


# L13 -------------------------------------------------------------------------------------------
def extreme_review(panel: DataFrame, ratio: float = 20.0, min_value: float = 3.0,
                   half_width_days: int = 183) -> DataFrame:
    """Daily values far above the station's mean non-zero value, then every row within half a
    year of each flagged day, for review."""
    flags = C.ratio_flags(panel, KEY, DATE, PRECIP, threshold=ratio, exclude_year=1973, min_value=min_value)
    return TS.neighbourhood(flags.select(*KEY, DATE), panel, KEY, DATE, DATE, half_width_days)
