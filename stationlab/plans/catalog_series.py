"""Registered queries, continued: time joins, sweeps, nearest places, exact selection, and the operators
that no other query reaches."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cleaning as C
from ..operators import continuity as SP
from ..operators import quality as Q
from ..operators import selection
from ..operators import stats as A
from ..operators import sweep
from ..operators import timejoin
from ..operators import stations as ST
from ..operators import summaries
from ..session import ensure_checkpoint_dir
from ..sources.headers import read_by_header
from ..sources.readers import read_splice_groups, write_csv
from ..sources.yearly import scan_years, write_years
from .catalog import REGISTRY, register, splice_groups
from . import pipelines as L
from .driver import customer_panel, supplier_panel, table
from .physical import materialize


@register("asof_lookup")
def asof_lookup(spark, sf_dir):
    """J14, many targets per key: for every order day of a supplier's lines, the supplier's next, last and nearest
    day with precipitation, and the amount on the last one."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    targets = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("key"), F.to_date("o_orderdate").alias("target")).distinct()
    wet = supplier_panel(spark, sf_dir).where("precip is not null")
    x = timejoin.asof_lookup(wet, targets, "key", "day", "target", {"next_day": "bfill", "last_day": "ffill", "near_day": "nearest"}, ["precip"],
                             n_rows=2 * li.count())
    return x.select("key", "target", "next_day", "last_day", "near_day", F.col("last_day_precip").alias("last_precip"))


@register("asof_events")
def asof_events(spark, sf_dir):
    """J14 on timestamps: for every event of a user, the user's last error before or at it and the next one."""
    e = table(spark, sf_dir, "events")
    x = timejoin.asof_lookup(e.where("event_type = 'error'"), e, "user_id", "ts", "ts", {"prev": "ffill", "next": "bfill"}, grain="micros")
    return x.select("event_id", F.unix_micros(F.col("prev").cast("timestamp")).alias("prev_micros"),
                    F.unix_micros(F.col("next").cast("timestamp")).alias("next_micros"))


@register("interval_members")
def interval_members(spark, sf_dir):
    """J10 over intervals of any length: a customer's order days inside the windows that the customer's orders open
    (1 to 700 days, by order number)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.to_date("o_orderdate").alias("opens"))
    o = o.withColumn("closes", F.date_add("opens", (F.pmod(F.col("o_orderkey") * 37, F.lit(700)) + 1).cast("int")))
    p = customer_panel(spark, sf_dir).select("key", "day", "value")
    return timejoin.interval_join(o, p, ["key"], "opens", "closes", "day").select("key", "day", "value", "o_orderkey")


@register("active_by_nation")
def active_by_nation(spark, sf_dir):
    """J9 on days, by group: customers of each nation between their first and last order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    ext = A.extent(customer_panel(spark, sf_dir), ["key"], "day").join(c, "key")
    return sweep.active_intervals(ext, "first_date", "last_date", "day", ["nation"])


@register("day_runs")
def day_runs(spark, sf_dir):
    """T6 as runs: each supplier's runs of days with and without precipitation over its own span."""
    return sweep.day_runs(supplier_panel(spark, sf_dir), "key", "day", "precip")


@register("day_runs_common")
def day_runs_common(spark, sf_dir):
    """T7 as runs: each customer's runs of days with and without an order over the whole table's span."""
    return sweep.day_runs(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key"), "key", "o_orderdate", common_span=True)


def _world(df, key, lat_step, lon_step):
    """Places all over the globe from an integer key."""
    return df.select(F.col(key).alias("key"), (F.pmod(F.col(key) * lat_step, F.lit(18001)) / 100.0 - 90.0).alias("latitude"),
                     (F.pmod(F.col(key) * lon_step, F.lit(36001)) / 100.0 - 180.0).alias("longitude"))


@register("nearest_place")
def nearest_place(spark, sf_dir):
    """J2 over a large reference table: the nearest part's place for every customer's, anywhere on the globe."""
    refs = _world(table(spark, sf_dir, "part"), "p_partkey", 7919, 104729).withColumn("place", F.col("key").cast("string"))
    pts = _world(table(spark, sf_dir, "customer"), "c_custkey", 6007, 15013)
    return ST.nearest_city(pts, refs, city_name="place", out_city="place").select("key", "place", "distance_km")


@register("quantiles_by_flag")
def quantiles_by_flag(spark, sf_dir):
    """A16/A21 by exact selection: quartiles and tails of two columns per return flag."""
    x = selection.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], [0.025, 0.25, 0.5, 0.75, 0.975], "l_returnflag")
    return x.withColumnsRenamed({f"q{i}": n for i, n in enumerate(["p2_5", "p25", "p50", "p75", "p97_5"])})


@register("quantiles_all")
def quantiles_all(spark, sf_dir):
    """A16 by exact selection with one group of all rows."""
    x = selection.exact_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.0, 0.001, 0.5, 0.999, 1.0])
    return x.withColumnsRenamed({f"q{i}": n for i, n in enumerate(["lowest", "p0_1", "p50", "p99_9", "highest"])})


@register("sliced_panel")
def sliced_panel(spark, sf_dir):
    """P12 + P13 + P9 + P4: the panel of 1996 to 1998 up to May, means kept where two lines were read, trimmed names."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("name"))
    p = C.month_at_most(C.date_slice(supplier_panel(spark, sf_dir), "day", "1996", "1998"), "day", 5)
    p = C.null_unless(p, F.col("temp_count") >= 2, ["temp_mean"])
    return C.trim_cols(p.join(s, "key"), ["name"]).select("key", "name", "day", "temp_mean")


@register("seeded_pick")
def seeded_pick(spark, sf_dir):
    """One customer by a seeded hash."""
    return C.seeded_pick(table(spark, sf_dir, "orders"), ["o_custkey"], 42)


@register("annual_without_last")
def annual_without_last(spark, sf_dir):
    """P21 on A8: annual sums without each supplier's last, incomplete year."""
    return C.drop_last_bin(C.annual_sum_count(supplier_panel(spark, sf_dir), ["key"], "day", "precip"), ["key"], "year")


@register("zscore_review")
def zscore_review(spark, sf_dir):
    """Unguarded z-scores between 0.5 and 2, for review."""
    return C.zscore_review(supplier_panel(spark, sf_dir), ["key"], "day", "precip", 0.5, 2.0, year=1995, last_month=5, min_rows=20)


@register("category_means")
def category_means(spark, sf_dir):
    """Mean price and quantity by ship mode flag and line status."""
    return A.group_stats(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"],
                         {"mean_quantity": F.avg("l_quantity"), "mean_cents": F.avg(F.round(F.col("l_extendedprice") * 100))})


@register("category_by_year")
def category_by_year(spark, sf_dir):
    """One supplier's quantity per category and year, then wide by category."""
    li = table(spark, sf_dir, "lineitem").where("l_suppkey = 7").withColumn("year", F.year("l_shipdate"))
    per = A.group_stats(li, ["l_returnflag", "year"], {"total": F.sum("l_quantity"), "mean": F.avg("l_quantity"), "lines": F.count("l_quantity")})
    return A.pivot_wide(per, ["year"], "l_returnflag", F.max("total"), ["A", "N", "R"], prefix="total_")


@register("user_spans")
def user_spans(spark, sf_dir):
    """Several columns and statistics at once per user, with the rows as years of hourly data."""
    x = A.group_stats(table(spark, sf_dir, "events"), ["user_id"],
                      {"n": F.count("value"), "first_ts": F.min("ts"), "last_ts": F.max("ts"), "low": F.min("value"), "high": F.max("value")})
    return x.withColumn("hourly_years", F.col("n") / F.lit(8766.0))


@register("distinct_counts")
def distinct_counts(spark, sf_dir):
    """Distinct values of several columns per return flag."""
    return A.distinct_count(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey", "l_shipdate"], ["l_returnflag"])


@register("indicator_profile")
def indicator_profile(spark, sf_dir):
    """Q2: quantity by whether a line had a discount or a tax."""
    li = table(spark, sf_dir, "lineitem").withColumns({"cut": F.col("l_discount") > 0.05, "taxed": F.col("l_tax") > 0.04})
    return Q.indicator_profile(li, Q.any_of(["cut", "taxed"]), "l_quantity")


@register("check_counts")
def check_counts(spark, sf_dir):
    """Q7: the nations are 25, each with its own name; fails otherwise."""
    return Q.check_counts(table(spark, sf_dir, "nation"), 25, ["n_name"], 25)


@register("largest_shifts")
def largest_shifts(spark, sf_dir):
    """The twenty pairs with the largest median shift of the mean, in order."""
    report = REGISTRY["splice_report"](spark, sf_dir)
    x = SP.order_by_shift(report.where("q_50 is not null").withColumn("down", -F.col("q_50")), "value", "mean", "down")
    return x.limit(20).select("group_id", "pair_no", "name", "q_50")


@register("ordered_extract")
def ordered_extract(spark, sf_dir):
    """J3 + O1 + O4: lines of customers in debt with their order, ordered by five columns, the first hundred."""
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    debt = c.where("c_acctbal < 0").select("c_custkey")
    x = o.join(debt, o.o_custkey == F.col("c_custkey"), "left_semi").join(li, li.l_orderkey == o.o_orderkey)
    cols = ["o_custkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    return x.orderBy(*cols).limit(100).select(*cols)


@register("near_or_long")
def near_or_long(spark, sf_dir):
    """P6 with bounds that reject and accept: suppliers within 150 km of a city and active for 6.57 years or more."""
    from .catalog import cities, supplier_stations

    st = ST.nearest_city(supplier_stations(spark, sf_dir), cities(spark, sf_dir))
    ext = A.extent(supplier_panel(spark, sf_dir), ["key"], "day")
    x = st.join(ext, "key").withColumn("duration_years", A.duration_years("first_date", "last_date"))
    return ST.near_and_long(x, 150.0, 6.57).select("key", "nearest_city", "distance_km", "duration_years")


@register("coverage_flags")
def coverage_flags(spark, sf_dir):
    """A7 with a threshold inside the data: years with more than 80 readings."""
    a = A.annual_stats(supplier_panel(spark, sf_dir), ["key"], "day", ["temp_mean"], stats=("mean",), count_cols=["temp_mean"])
    return a.withColumn("good", A.coverage_flag("count_temp_mean", 100.0, 0.8)).select("key", "period", "count_temp_mean", "good")


@register("splice_medians")
def splice_medians(spark, sf_dir):
    """Pluggable statistics (C9): 95 % intervals of the shift of the median and of a custom statistic, one pass."""
    from .catalog import SPLICE_SAMPLES, SPLICE_SEED, SPLICE_YEARS, splice_panel

    pairs = SP.splice_pairs(splice_groups(spark, sf_dir), ["key"])
    bins = SP.splice_windows(splice_panel(spark, sf_dir), pairs, ["key"], "day", ["value"], window_years=SPLICE_YEARS)
    def median(v):
        v = np.sort(v, axis=0)
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    stats = {"median": SP.MatrixStatistic(median), "spread": SP.MatrixStatistic(lambda v: v.max(axis=0) - np.fmin.reduce(v, axis=0))}
    diff = SP.bootstrap_diffs(bins, ["value"], SPLICE_SAMPLES, SPLICE_SEED, stats, per_pair=True)
    return SP.bootstrap_ci(diff, (0.025, 0.5, 0.975))


def _scratch(spark, name):
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("csv_by_header")
def csv_by_header(spark, sf_dir):
    """The supplier panel written as CSV exports with two column orders and a further column, read again as one
    source by header."""
    p = supplier_panel(spark, sf_dir).select("key", "day", "temp_mean", "temp_count", "precip")
    folder = _scratch(spark, "csv")
    write_csv(p.where("key % 2 = 0"), f"{folder}/even")
    write_csv(p.where("key % 2 = 1").select("precip", F.lit("x").alias("note"), "day", "temp_count", "key", "temp_mean"), f"{folder}/odd")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("day", T.DateType()), T.StructField("temp_mean", T.DoubleType()),
                           T.StructField("temp_count", T.ShortType()), T.StructField("precip", T.DoubleType())])
    return read_by_header(spark, [f"{folder}/even", f"{folder}/odd"], schema)


@register("yearly_tables")
def yearly_tables(spark, sf_dir):
    """The panel as yearly tables, 1997 replaced by one with a further column and whole-number means, then
    rows and sums per year of a scan from 1996 on."""
    p = supplier_panel(spark, sf_dir).select("key", "day", "temp_mean", F.year("day").alias("year"))
    path = _scratch(spark, "yearly")
    write_years(p, path)
    write_years(p.where("year = 1997").withColumns({"temp_mean": F.col("temp_mean").cast("long") + 1, "checked": F.lit(True)}), path)
    x = scan_years(spark, path).where("year >= 1996")
    return x.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("temp_mean").alias("total"), F.count("checked").alias("checked"))


@register("groups_from_file")
def groups_from_file(spark, sf_dir):
    """S6 + J11: nations grouped by region from a file without ordinals, paired in file order."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("pair_id"), F.col("n_nationkey").alias("usaf"), F.lit("9").alias("wban"), F.col("n_name").alias("name"))
    path = _scratch(spark, "groups")
    write_csv(n.coalesce(1).sortWithinPartitions(F.desc("name")), path)
    pairs = SP.splice_pairs(read_splice_groups(spark, path), ["usaf", "wban"])
    return pairs.select("group_id", "pair_no", F.col("a_usaf").cast("long").alias("a"), F.col("b_usaf").cast("long").alias("b"))


@register("merged_summaries")
def merged_summaries(spark, sf_dir):
    """A16/A28/A10 from stored (key, year) summaries: rows, years, moments and bounds of 1996 to 1999 per supplier (the
    exact figures; sketches are tested against the rows)."""
    s = materialize(summaries.summarise(supplier_panel(spark, sf_dir), "key", "day", ["temp_mean"]))
    x = summaries.figures(summaries.merge(s, "key", 1996, 1999), [])
    return x.select("key", "n_rows", "n_years", "first_date", "last_date", "n_temp_mean", "mean_temp_mean", "std_temp_mean", "min_temp_mean", "max_temp_mean")


# --- the workflow's report and shortlist, with customers as stations -----------------------------
SHORTLIST = {"threshold_years": 0.1, "threshold_date": "1995-02-01"}
PREFIXES = ["Customer#0000000", "Customer#0000001", "Customer#00000102"]
NOT_NAMED = ["Customer#000000100", "Customer#000000007"]


def _customer_stations(spark, sf_dir):
    """Rows: a customer's ship days with the largest quantity (NULL where it is under 10); stations: the customers
    with their order dates as the nominal span (open where the last order is the customer's only one)."""
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    key = {"usaf": F.col("o_custkey").cast("string"), "wban": F.lit("99999")}
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select("o_custkey", F.to_date("l_shipdate").alias("timestamp"), "l_quantity")
    daily = rows.groupBy("o_custkey", "timestamp").agg(F.max("l_quantity").alias("q")) \
        .select(*[v.alias(k) for k, v in key.items()], "timestamp", F.when(F.col("q") >= 10, F.col("q")).alias("temp_f_mean"))
    spans = o.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("b"), F.max(F.to_date("o_orderdate")).alias("e"))
    stations = spans.join(c, spans.o_custkey == c.c_custkey).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")) \
        .select(*[v.alias(k) for k, v in key.items()], F.col("c_name").alias("name"), F.col("n_name").alias("nearest_city"),
                F.col("b").alias("nominal_begin_date"), F.when(F.col("e") > F.col("b"), F.col("e")).alias("nominal_end_date"))
    return daily, stations


@register("nominal_agreement")
def nominal_agreement(spark, sf_dir):
    """Nominal against actual spans with repaired ends (A1, A3, P10, Q6)."""
    x = L.nominal_agreement(*_customer_stations(spark, sf_dir), last_year=2001, cutoff="2001-06-01")
    return x.select("usaf", "operating", "modified_end", "nominal_days", "actual_days", "begin_diff_days", "end_diff_days", "modified_diff_days")


@register("agreement_shares")
def agreement_shares(spark, sf_dir):
    """Shares of stations whose dates are off by a week, a year, five years."""
    return L.agreement_shares(L.nominal_agreement(*_customer_stations(spark, sf_dir), last_year=2001, cutoff="2001-06-01"))


@register("shortlist")
def shortlist(spark, sf_dir):
    """Long or early stations with coverage, by name prefix, without false positives."""
    x = L.shortlist(*_customer_stations(spark, sf_dir), **SHORTLIST, not_named=NOT_NAMED,
                    prefixes=spark.createDataFrame([(p,) for p in PREFIXES], "prefix string"))
    return x.select("usaf", "name", "nearest_city", "first_date", "last_date", "record_count", "time_coverage")


@register("shortlist_periods")
def shortlist_periods(spark, sf_dir):
    """Days with a reading per anchored 12-month period of the shortlisted stations."""
    daily, stations = _customer_stations(spark, sf_dir)
    return L.shortlist_periods(daily, L.shortlist(daily, stations, **SHORTLIST)).drop("wban")
