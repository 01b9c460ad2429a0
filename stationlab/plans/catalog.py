"""Registered driver queries (Spark side).  Each takes (spark, sf_dir) and returns a tidy
DataFrame whose column names match the SQL oracle in :mod:`stationlab.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import below_flag, daily_spread
from ..operators import cleaning as C
from ..operators import stats as A
from .driver import customer_panel, supplier_panel, table
from .tidy import tidy

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        return fn
    return deco


@register("extent_coverage")
def extent_coverage(spark, sf_dir):
    """A1 + A2 on orders per customer."""
    o = table(spark, sf_dir, "orders")
    return A.extent_coverage(o, ["o_custkey"], "o_orderdate")


@register("annual_stats_dense")
def annual_stats_dense(spark, sf_dir):
    """P16 + A6 + P11 + A7 on the supplier panel, dense over each supplier's years."""
    p = supplier_panel(spark, sf_dir).withColumns({
        "spread": daily_spread("temp_max", "temp_min"),
        "frost": below_flag("temp_min", 250.0),
    })
    a = A.annual_stats(p, ["key"], "day", ["temp_mean", "temp_max", "temp_min", "spread", "precip"],
                       sum_cols=["frost"], count_cols=["temp_mean", "precip"])
    a = C.zero_to_null(a, ["mean_precip", "max_precip"])
    return a.withColumns({
        "good_temp_coverage": A.coverage_flag("count_temp_mean"),
        "good_precip_coverage": A.coverage_flag("count_precip"),
    })


@register("annual_sum_sparse")
def annual_sum_sparse(spark, sf_dir):
    """A8 (T1 sparse years) on the supplier panel's precipitation stand-in."""
    return C.annual_sum_count(supplier_panel(spark, sf_dir), ["key"], "day", "precip")


@register("implausible_years")
def implausible_years(spark, sf_dir):
    """A9 with thresholds scaled to the panel (count >= 60 days, total < 400)."""
    return C.implausible_years(supplier_panel(spark, sf_dir), ["key"], "day", "precip", min_count=60, max_sum=400.0)


SENTINELS = {"l_quantity": 50.0, "l_tax": 0.08, "l_discount": 0.1}


@register("sentinel_null_profile")
def sentinel_null_profile(spark, sf_dir):
    """P2 (markers chosen to hit real values) + A19 null profile by return flag."""
    x = C.clean_sentinels(table(spark, sf_dir, "lineitem"), SENTINELS)
    return A.null_profile(x, list(SENTINELS), by=["l_returnflag"])


@register("sentinel_maxima")
def sentinel_maxima(spark, sf_dir):
    """P2 + P3 ({10: 0} on a short code column) + A20 column maxima."""
    li = table(spark, sf_dir, "lineitem").withColumn("qty_code", F.col("l_quantity").cast("short"))
    x = C.recode(C.clean_sentinels(li, SENTINELS), ["qty_code"], {10: 0})
    return A.column_maxima(x, ["l_quantity", "l_tax", "l_discount", "qty_code"],
                           extra={"n_recoded": F.count_if(F.col("qty_code") == 0)})


def exclusion_points(spark, sf_dir):
    """S4 stand-in: (supplier, day) of large returned lines; repeats on purpose."""
    li = table(spark, sf_dir, "lineitem")
    return li.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)).select(
        F.col("l_suppkey").alias("key"), F.to_date("l_shipdate").alias("day"))


def exclusion_years(spark, sf_dir):
    """S5 stand-in: (supplier, year) in which the supplier shipped a size-1 part."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").where(F.col("p_size") == 1).select("p_partkey")
    return li.join(part, li.l_partkey == part.p_partkey, "left_semi").select(
        F.col("l_suppkey").alias("key"), F.year("l_shipdate").alias("year")).distinct()


@register("null_points_years")
def null_points_years(spark, sf_dir):
    """J7 + J8: NULL the panel's precipitation at listed points and in listed years."""
    p = supplier_panel(spark, sf_dir).select("key", "day", "precip", "temp_mean")
    p = C.null_at_points(p, exclusion_points(spark, sf_dir), ["key"], "day", "precip")
    return C.null_at_years(p, exclusion_years(spark, sf_dir), ["key"], "day", "precip")


@register("gap_keys")
def gap_keys(spark, sf_dir):
    """A10 on the customer panel: customers with orders in 1995-2000 but in fewer than 6 of those years."""
    return C.gap_keys(customer_panel(spark, sf_dir), ["key"], "day", 1995, 2000)


@register("gap_filter")
def gap_filter(spark, sf_dir):
    """Those customers lose their rows before 1998-01-01."""
    p = customer_panel(spark, sf_dir).select("key", "day", "value")
    return C.remove_before_if_gap(p, ["key"], "day", "1998-01-01", 1995, 2000)


@register("anomaly_zscore")
def anomaly_zscore(spark, sf_dir):
    """1995 Jan-May total against later Jan-May totals, >= 20 rows in the span."""
    return C.anomaly_zscore(supplier_panel(spark, sf_dir), ["key"], "day", "precip", 1995, 5, min_rows=20)


@register("remove_anomalous_span")
def remove_anomalous_span(spark, sf_dir):
    """Drop the 1995 Jan-May rows of suppliers with z > 1."""
    p = supplier_panel(spark, sf_dir).select("key", "day", "precip")
    return C.remove_anomalous_span(p, ["key"], "day", "precip", 1995, 5, threshold=1.0, min_rows=20)


@register("ratio_flags")
def ratio_flags(spark, sf_dir):
    """Order-day value over the customer's mean non-zero value (1995 left out) above 2."""
    p = customer_panel(spark, sf_dir).select("key", "day", "value")
    return C.ratio_flags(p, ["key"], "day", "value", threshold=2.0, exclude_year=1995)


@register("extreme_neighbourhood")
def extreme_neighbourhood(spark, sf_dir):
    """A15 -> J10: rows within +-183 days of each flagged day (ratio above 2.5), same customer."""
    p = customer_panel(spark, sf_dir).select("key", "day", "value")
    flags = C.ratio_flags(p, ["key"], "day", "value", threshold=2.5, exclude_year=1995)
    from ..operators.timeseries import neighbourhood

    return neighbourhood(flags.select("key", "day"), p, ["key"], "day", "day", 183)


@register("clean_pipeline")
def clean_pipeline(spark, sf_dir):
    """L4 + L5 on the supplier panel, in two passes over the rows: drop listed suppliers ->
    exclusions (points, years, implausible years judged on the input) -> anomalous span removal
    on the nulled values -> gap rule after that removal."""
    p = supplier_panel(spark, sf_dir).select("key", "day", "precip", "temp_mean")
    dropped = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("key"))
    return C.clean_dataset(p, ["key"], "day", "precip", points=exclusion_points(spark, sf_dir),
                           years=exclusion_years(spark, sf_dir), dropped=dropped, min_count=60, max_sum=400.0,
                           z_year=1995, z_last_month=5, z_threshold=1.0, z_min_rows=20,
                           gap_first=1995, gap_last=2001, gap_cutoff="1997-01-01")


@register("clean_pipeline_stepwise")
def clean_pipeline_stepwise(spark, sf_dir):
    """The same chain composed rule by rule (one pass over the rows per rule), kept as the
    reference for the two-pass plan."""
    p = supplier_panel(spark, sf_dir).select("key", "day", "precip", "temp_mean")
    x = C.null_excluded(p, ["key"], "day", "precip", points=exclusion_points(spark, sf_dir),
                        years=exclusion_years(spark, sf_dir), min_count=60, max_sum=400.0)
    x = C.remove_anomalous_span(x, ["key"], "day", "precip", 1995, 5, threshold=1.0, min_rows=20)
    dropped = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("key"))
    x = C.drop_keys(x, dropped, ["key"])
    return C.remove_before_if_gap(x, ["key"], "day", "1997-01-01", 1995, 2001)


# --- stations and cities ------------------------------------------------------------------------
from ..operators import stations as ST  # noqa: E402
from ..operators import timeseries as TS  # noqa: E402
from .driver import city_coords, station_coords  # noqa: E402


def supplier_stations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), "s_name", "s_acctbal")
    return station_coords(s, "key")


def cities(spark, sf_dir):
    return city_coords(table(spark, sf_dir, "nation"))


@register("distance_pairs")
def distance_pairs(spark, sf_dir):
    """Every supplier x every nation-city, haversine km."""
    return ST.distance_pairs(supplier_stations(spark, sf_dir).select("key", "latitude", "longitude"),
                             cities(spark, sf_dir)).select("key", "city", "distance_km")


@register("nearest_city")
def nearest_city(spark, sf_dir):
    """Nearest nation-city per supplier (ties by name)."""
    return ST.nearest_city(supplier_stations(spark, sf_dir), cities(spark, sf_dir), keys=["key"]) \
        .select("key", "nearest_city", "distance_km")


@register("near_and_long")
def near_and_long(spark, sf_dir):
    """J2 + A1 + A5 + P6: suppliers within 300 km of a city whose series spans >= 6.5 years."""
    st = ST.nearest_city(supplier_stations(spark, sf_dir), cities(spark, sf_dir), keys=["key"])
    ext = A.extent(supplier_panel(spark, sf_dir), ["key"], "day")
    x = st.join(ext, "key").withColumn("duration_years", A.duration_years("first_date", "last_date"))
    return ST.near_and_long(x, 300.0, 6.5).select("key", "nearest_city", "distance_km", "duration_years")


@register("city_members")
def city_members(spark, sf_dir):
    """(city, supplier) for every supplier within 400 km of a city."""
    return ST.city_members(supplier_stations(spark, sf_dir), cities(spark, sf_dir), ["key"], 400.0)


@register("active_count")
def active_count(spark, sf_dir):
    """Customers active (first..last order) at each month start."""
    ext = A.extent(customer_panel(spark, sf_dir), ["key"], "day")
    return ST.active_count(ext, "first_date", "last_date")


# --- bins and grids -----------------------------------------------------------------------------
@register("bins_12m_anchored")
def bins_12m_anchored(spark, sf_dir):
    """12-month bins from each customer's first order month; non-null values per bin (>0)."""
    p = customer_panel(spark, sf_dir)
    b = TS.anchored_month_bins(p, ["key"], "day", 12)
    return b.groupBy("key", "period_start", "period_end").agg(F.count("value").alias("count_days")) \
        .where(F.col("count_days") > 0)


@register("bins_7d_anchored")
def bins_7d_anchored(spark, sf_dir):
    """T4: 7-day bins from each user's first event day; max value per bin."""
    ev = table(spark, sf_dir, "events")
    b = TS.anchored_day_bins(ev, ["user_id"], "ts", 7)
    return b.groupBy("user_id", "period_start").agg(F.max("value").alias("max_value"))


@register("bins_365d_end")
def bins_365d_end(spark, sf_dir):
    """T5: 365-day bins counted back from each supplier's last day; mean per bin, empty bins kept."""
    p = supplier_panel(spark, sf_dir)
    b = TS.end_anchored_bins(p, ["key"], "day", 365)
    means = b.groupBy("key", "bin").agg(F.avg("temp_mean").alias("mean_temp"))
    return TS.fill_bins(means, ["key"], "bin")        # bin 0 always has the last day


@register("daily_grid")
def daily_grid(spark, sf_dir):
    """Per-user daily grid over the user's span; 1 where the day has no value."""
    return TS.daily_grid(table(spark, sf_dir, "events"), ["user_id"], "ts", "value")


@register("all_keys_grid")
def all_keys_grid(spark, sf_dir):
    """Every user x every day of the table's span, the user's daily total where present."""
    ev = table(spark, sf_dir, "events")
    daily = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(F.round(F.col("value") * 100)).alias("total"))
    return TS.all_keys_grid(daily, ["user_id"], "day", ["total"])


@register("daily_sum_filled")
def daily_sum_filled(spark, sf_dir):
    """Daily sum of each user's event values (in cents), empty days 0."""
    ev = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100))
    return TS.daily_sum_filled(ev, ["user_id"], "ts", "cents")


@register("annual_median")
def annual_median(spark, sf_dir):
    """T9 + P17: annual median of a letter code mapped to a number (A..I -> 0..8), dense years."""
    o = table(spark, sf_dir, "orders").withColumn(
        "code", F.substring(F.regexp_replace("o_orderpriority", "[^A-Z]", ""), 1, 1))
    from ..functions.columns import letter_rank

    return TS.annual_median(o, ["o_orderstatus"], "o_orderdate", letter_rank("code"), "median_code")


# --- keys and sets ------------------------------------------------------------------------------
@register("semi_keep")
def semi_keep(spark, sf_dir):
    """Orders of listed customers (segment BUILDING)."""
    keys = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING") \
        .select(F.col("c_custkey").alias("o_custkey"))
    return C.keep_keys(table(spark, sf_dir, "orders"), keys, ["o_custkey"]).select("o_orderkey", "o_custkey")


@register("anti_drop")
def anti_drop(spark, sf_dir):
    """Customer panel without customers whose balance is negative."""
    keys = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("key"))
    return C.drop_keys(customer_panel(spark, sf_dir), keys, ["key"]).select("key", "day", "value")


@register("union_filter")
def union_filter(spark, sf_dir):
    """One OR filter for two populations (listed nations of one segment, or another
    segment inside numeric bounds) instead of a union of two scans."""
    c = table(spark, sf_dir, "customer").withColumn("c_nation", F.col("c_nationkey").cast("string"))
    cond = C.in_region("c_mktsegment", "c_nation", "c_acctbal", "c_nationkey", ["1", "2", "3"], "MACHINERY",
                       0.0, 10.0, us_country="BUILDING")
    return c.where(cond).select("c_custkey", "c_mktsegment", "c_nationkey")


@register("distinct_keys")
def distinct_keys(spark, sf_dir):
    """Customers ordering in 1995 stacked with those ordering in 2001, duplicates dropped."""
    o = table(spark, sf_dir, "orders")
    a = o.where(F.year("o_orderdate") == 1995).select(F.col("o_custkey").alias("key"))
    b = o.where(F.year("o_orderdate") == 2001).select(F.col("o_custkey").alias("key"))
    return a.unionByName(b).distinct()


@register("prefix_match")
def prefix_match(spark, sf_dir):
    """Parts whose trimmed name starts with a listed prefix, each part once."""
    prefixes = spark.createDataFrame([("small",), ("red w",), ("blue",), ("hot r",)], "prefix string")
    return ST.prefix_match(table(spark, sf_dir, "part"), "p_name", prefixes).select("p_partkey", "p_name")


@register("contains_text")
def contains_text(spark, sf_dir):
    """Parts whose name contains 'RING' in any case."""
    return table(spark, sf_dir, "part").where(ST.contains_ci("p_name", "RING")).select("p_partkey", "p_name")


# --- statistics ---------------------------------------------------------------------------------
from ..operators import quality as Q  # noqa: E402


@register("describe_numeric")
def describe_numeric(spark, sf_dir):
    """Describe event values (cents) per event type, exact linear quantiles."""
    ev = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100))
    return A.describe(ev, ["cents"], by=["event_type"])


@register("describe_text")
def describe_text(spark, sf_dir):
    """Count, distinct, top value and its frequency of order priority per status."""
    return A.describe_text(table(spark, sf_dir, "orders"), "o_orderpriority", by=["o_orderstatus"])


@register("value_counts")
def value_counts(spark, sf_dir):
    """Frequencies of (return flag, line status) with their share."""
    return A.value_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], normalize=True)


@register("null_share")
def null_share(spark, sf_dir):
    """Share of zero discounts and of NULL precipitation stand-in per return flag."""
    li = table(spark, sf_dir, "lineitem")
    return A.fraction_by(li, ["l_returnflag"], {
        "zero_share": F.col("l_discount") == 0,
        "null_share": F.nullif(F.col("l_discount"), F.lit(0.0)).isNull(),
        "big_share": F.col("l_quantity") > 45,
    })


@register("histogram")
def histogram(spark, sf_dir):
    """7 equal bins of quantity over [1, 50] per line status, last bin closed, with density."""
    return A.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 7, 1.0, 50.0, by=["l_linestatus"], density=True)


@register("histogram_log")
def histogram_log(spark, sf_dir):
    """20 bins of log10(extended price) over the data's own range."""
    return A.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20, log10=True)


@register("ecdf")
def ecdf(spark, sf_dir):
    """Cumulative share of quantity over 10 bins of [0, 50] per return flag."""
    return A.ecdf(table(spark, sf_dir, "lineitem"), "l_quantity", 10, 0.0, 50.0, by=["l_returnflag"])


@register("fraction_over")
def fraction_over(spark, sf_dir):
    """A4: shares of large and of urgent orders per status."""
    return A.fraction_by(table(spark, sf_dir, "orders"), ["o_orderstatus"], {
        "share_big": F.col("o_totalprice") > 200000,
        "share_urgent": F.col("o_orderpriority") == "1-URGENT",
    })


@register("nominal_vs_actual")
def nominal_vs_actual(spark, sf_dir):
    """A3 + P10: each supplier's nominal span (dates of the orders it served) against its actual
    ship-day span; nominal ends from 2001-06-01 on are replaced by the table's last ship day."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    nominal = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("l_suppkey").alias("key")).agg(
        F.min(F.to_date("o_orderdate")).alias("nominal_begin"), F.max(F.to_date("o_orderdate")).alias("nominal_end"))
    ext = A.extent(li.withColumnRenamed("l_suppkey", "key"), ["key"], "l_shipdate")
    x = A.nominal_vs_actual(nominal.join(ext, "key"), "nominal_begin", "nominal_end")
    last_all = li.agg(F.max(F.to_date("l_shipdate"))).first()[0]
    return x.withColumn("capped_end", A.cap_end_date("nominal_end", "2001-06-01", F.lit(last_all)))


def _city_year(spark, sf_dir):
    """A6 -> A7 -> P9 -> A30: nation-year mean of supplier-year means that pass a coverage flag."""
    p = supplier_panel(spark, sf_dir)
    a = A.annual_stats(p, ["key"], "day", ["temp_mean"], stats=("mean",), count_cols=["temp_mean"], dense=False)
    a = a.withColumn("qc", F.when(A.coverage_flag("count_temp_mean", 100.0, 0.6), F.col("mean_temp_mean")))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("city"))
    x = a.join(s, "key").join(n, "s_nationkey")
    return x.groupBy("city", "period").agg(F.avg("qc").alias("city_mean")).withColumn("year", F.year("period"))


@register("group_trend")
def group_trend(spark, sf_dir):
    """OLS slope/intercept of the nation-year means over years (NULL years skipped)."""
    return A.linear_trend(_city_year(spark, sf_dir), ["city"], "year", "city_mean")


@register("group_corr")
def group_corr(spark, sf_dir):
    """Pearson correlation between nations over common years."""
    return A.corr_matrix(_city_year(spark, sf_dir), "city", "period", "city_mean")


@register("centered")
def centered(spark, sf_dir):
    """Nation-year means minus the nation's 1996 value."""
    return A.center_on(_city_year(spark, sf_dir), ["city"], "period", "city_mean", "1996-01-01") \
        .select("city", "period", "centered")


@register("normalised")
def normalised(spark, sf_dir):
    """Nation-year means over the nation's maximum."""
    return A.normalise_by_max(_city_year(spark, sf_dir), ["city"], "city_mean").select("city", "period", "normalised")


@register("top_k")
def top_k(spark, sf_dir):
    """O3: the 5 largest orders (ties by key)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return A.top_k(o, 5, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@register("top_k_by_group")
def top_k_by_group(spark, sf_dir):
    """O3 by group: the 3 largest orders of each priority."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return A.top_k(o, 3, [F.col("o_totalprice").desc(), F.col("o_orderkey")], by=["o_orderpriority"])


@register("row_at_max")
def row_at_max(spark, sf_dir):
    """The whole order row at the maximum price per status (ties: smallest key)."""
    o = table(spark, sf_dir, "orders")
    return A.row_at_max(o, "o_totalprice", by=["o_orderstatus"], tiebreak=["o_orderkey"])


@register("longest_by_group")
def longest_by_group(spark, sf_dir):
    """Per nation, the best record length (orders / 365.25) of its customers."""
    ext = A.extent(customer_panel(spark, sf_dir), ["key"], "day").withColumn(
        "years", F.col("record_count") / F.lit(365.25))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey")
    return A.best_per_group(ext.join(c, "key"), ["c_nationkey"], "years")


@register("cross_field_checks")
def cross_field_checks(spark, sf_dir):
    """Q1: readings out of order (min > mean, mean > max) and a cross-column rule."""
    p = supplier_panel(spark, sf_dir)
    return Q.rule_violations(p, {
        "min_gt_mean": F.col("temp_min") > F.col("temp_mean"),
        "mean_gt_max": F.col("temp_mean") > F.col("temp_max"),
        "mean_lt_precip": F.col("temp_mean") < F.col("precip"),
    })


@register("pressure_rule")
def pressure_rule(spark, sf_dir):
    """Q3: rule 'tax < discount' counted by flag, lines with discount < 0.02 excluded."""
    li = table(spark, sf_dir, "lineitem").where(~(F.col("l_discount") < 0.02))
    return A.value_counts(li.withColumn("violates", F.col("l_tax") < F.col("l_discount")), ["violates"])


@register("duplicates")
def duplicates(spark, sf_dir):
    """Duplicate (order, line number) keys in lineitem."""
    return A.duplicate_count(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("resolution_profile")
def resolution_profile(spark, sf_dir):
    """Q4: how often each per-supplier max / p75 / min of the reading count occurs."""
    return Q.resolution_profile(supplier_panel(spark, sf_dir), ["key"], "temp_count")


@register("filtered_coverage")
def filtered_coverage(spark, sf_dir):
    """Q5: mean readings kept where at least 2 lines were read that day, over expected days."""
    return Q.filtered_coverage(supplier_panel(spark, sf_dir), ["key"], "day", "temp_mean", "temp_count", 2)


@register("operating")
def operating(spark, sf_dir):
    """Q6: customers whose last order falls in 2001."""
    return Q.last_year_is(customer_panel(spark, sf_dir), ["key"], "day", 2001)


@register("pivot_wide")
def pivot_wide(spark, sf_dir):
    """V1: quantity per return flag, one column per ship year that occurs."""
    li = table(spark, sf_dir, "lineitem").withColumn("yr", F.year("l_shipdate"))
    return A.pivot_wide(li, ["l_returnflag"], "yr", F.sum("l_quantity"), prefix="y")


@register("unpivot_long")
def unpivot_long(spark, sf_dir):
    """V2: the wide table back to (flag, year, quantity)."""
    w = pivot_wide(spark, sf_dir)
    long = A.unpivot_long(w, ["l_returnflag"], [c for c in w.columns if c != "l_returnflag"], "year", "qty")
    return long.withColumn("year", F.substring("year", 2, 4).cast("int"))


# --- splice continuity --------------------------------------------------------------------------
from ..operators import continuity as SP  # noqa: E402

SPLICE_YEARS = 10
SPLICE_SAMPLES = 2000
SPLICE_SEED = 7


def splice_groups(spark, sf_dir):
    """S6 stand-in: customers grouped by nation, ordered by key."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("pair_id"), F.col("c_custkey").alias("key"),
                    F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("name"))


@register("splice_pairs")
def splice_pairs(spark, sf_dir):
    """Consecutive customers of each nation as pairs."""
    return SP.splice_pairs(splice_groups(spark, sf_dir), ["key"])


@register("splice_order")
def splice_order(spark, sf_dir):
    """Which member of each pair ends first, the splice date, and ties."""
    pairs = SP.splice_pairs(splice_groups(spark, sf_dir), ["key"])
    return SP.splice_order(customer_panel(spark, sf_dir), pairs, ["key"], "day")


@register("lookup_date")
def lookup_date(spark, sf_dir):
    """Each customer's first order on/after, last order on/before and nearest order to 1998-01-01."""
    p = customer_panel(spark, sf_dir)
    targets = p.select("key").distinct().withColumn("target", F.lit("1998-01-01").cast("date"))
    return TS.lookup_dates(p, ["key"], "day", targets, "target",
                           {"bfill_date": "bfill", "ffill_date": "ffill", "nearest_date": "nearest"})


def splice_panel(spark, sf_dir):
    """Customer panel on log scale (log of the day's order value in cents, log of 1 + orders)."""
    return customer_panel(spark, sf_dir).select("key", "day", F.ln("value").alias("value"),
                                                F.ln(F.col("n_orders") + 1).alias("n_orders"))


def _splice_bins(spark, sf_dir):
    pairs = SP.splice_pairs(splice_groups(spark, sf_dir), ["key"])
    return SP.splice_windows(splice_panel(spark, sf_dir), pairs, ["key"], "day", ["value", "n_orders"],
                             window_years=SPLICE_YEARS)


@register("splice_windows")
def splice_windows(spark, sf_dir):
    """10-year windows either side of each splice, 365-day bins from each side's end."""
    return _splice_bins(spark, sf_dir)


@register("splice_diff")
def splice_diff(spark, sf_dir):
    """C5 + C10: per pair and bootstrap sample, late - early of mean and std of the bin means."""
    return SP.bootstrap_diffs(_splice_bins(spark, sf_dir), ["value", "n_orders"], SPLICE_SAMPLES, SPLICE_SEED)


@register("splice_bootstrap")
def splice_bootstrap(spark, sf_dir):
    """2.5/50/97.5 % quantiles of the bootstrapped differences, long form."""
    diff = SP.bootstrap_diffs(_splice_bins(spark, sf_dir), ["value", "n_orders"], SPLICE_SAMPLES, SPLICE_SEED, per_pair=True)
    return SP.bootstrap_ci(diff, (0.025, 0.5, 0.975))


@register("splice_report")
def splice_report(spark, sf_dir):
    """The whole report, named by each pair's first station."""
    return SP.splice_report(splice_panel(spark, sf_dir), splice_groups(spark, sf_dir), ["key"], "day", ["value", "n_orders"],
                            window_years=SPLICE_YEARS, n_samples=SPLICE_SAMPLES, seed=SPLICE_SEED)


@register("jitter_hist")
def jitter_hist(spark, sf_dir):
    """P20 -> A22: jitter of quantities drawn from each line's key, then a 30-bin log histogram."""
    li = C.jitter(table(spark, sf_dir, "lineitem"), "l_quantity", 11, ["l_orderkey", "l_linenumber", "l_partkey"], out="jq")
    return A.histogram(li, "jq", 30, log10=True)


from . import catalog_series  # noqa: E402, F401  (registers the remaining queries)
