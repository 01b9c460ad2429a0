"""SQL oracles (DuckDB dialect) of the queries in :mod:`stationlab.plans.catalog_series`.  Placeholders in
braces are the panels and parts of :mod:`stationlab.plans.oracle`, filled in there."""

from __future__ import annotations

SERIES: dict[str, str] = {}

SERIES["asof_lookup"] = """
WITH w AS (SELECT key, day, precip FROM ({SUPPLIER_PANEL}) WHERE precip IS NOT NULL),
t AS (SELECT DISTINCT l_suppkey AS key, CAST(o_orderdate AS DATE) AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT t.key, t.target, min(CASE WHEN day >= target THEN day END) AS next_day, max(CASE WHEN day <= target THEN day END) AS last_day,
             first(day ORDER BY abs(date_diff('day', target, day)), day) AS near_day
      FROM t LEFT JOIN w ON t.key = w.key GROUP BY 1, 2)
SELECT x.key, CAST(target AS VARCHAR) AS target, CAST(next_day AS VARCHAR) AS next_day, CAST(last_day AS VARCHAR) AS last_day,
       CAST(near_day AS VARCHAR) AS near_day, round(w.precip, 4) AS last_precip
FROM x LEFT JOIN w ON x.key = w.key AND x.last_day = w.day
"""

SERIES["asof_events"] = """
WITH r AS (SELECT user_id, ts FROM events WHERE event_type = 'error')
SELECT e.event_id, epoch_us(max(CASE WHEN r.ts <= e.ts THEN r.ts END)) AS prev_micros, epoch_us(min(CASE WHEN r.ts >= e.ts THEN r.ts END)) AS next_micros
FROM events e LEFT JOIN r ON r.user_id = e.user_id GROUP BY e.event_id, e.ts
"""

SERIES["interval_members"] = """
WITH o AS (SELECT o_custkey AS key, o_orderkey, CAST(o_orderdate AS DATE) AS opens, (o_orderkey * 37) % 700 + 1 AS len FROM orders)
SELECT p.key, CAST(p.day AS VARCHAR) AS day, round(p.value, 4) AS value, o.o_orderkey
FROM ({CUSTOMER_PANEL}) p JOIN o ON p.key = o.key AND p.day BETWEEN o.opens AND o.opens + CAST(o.len AS INTEGER)
"""

SERIES["active_by_nation"] = """
WITH e AS (SELECT c_nationkey AS nation, key, min(day) AS b, max(day) AS e FROM ({CUSTOMER_PANEL}) JOIN customer ON key = c_custkey GROUP BY 1, 2),
g AS (SELECT nation, min(b) AS lo, max(e) AS hi FROM e GROUP BY 1),
s AS (SELECT nation, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM g)
SELECT CAST(s.nation AS BIGINT) AS nation, CAST(s.day AS VARCHAR) AS day, CAST(count(e.key) AS BIGINT) AS active
FROM s LEFT JOIN e ON e.nation = s.nation AND s.day BETWEEN e.b AND e.e GROUP BY 1, 2
"""


def _runs(days: str, span: str) -> str:
    """Runs by the difference of day and row number, over an expanded daily grid."""
    return f"""
WITH p AS ({days}), s AS ({span}),
g AS (SELECT key, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM s),
m AS (SELECT g.key, g.day, p.day IS NULL AS missing FROM g LEFT JOIN p ON p.key = g.key AND p.day = g.day),
r AS (SELECT *, date_diff('day', DATE '1990-01-01', day) - row_number() OVER (PARTITION BY key, missing ORDER BY day) AS run FROM m)
SELECT key, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, CAST(count(*) AS BIGINT) AS days, missing
FROM r GROUP BY key, missing, run
"""


SERIES["day_runs"] = _runs("SELECT key, day FROM ({SUPPLIER_PANEL}) WHERE precip IS NOT NULL",
                           "SELECT key, min(day) AS lo, max(day) AS hi FROM ({SUPPLIER_PANEL}) GROUP BY 1")
SERIES["day_runs_common"] = _runs(
    "SELECT DISTINCT o_custkey AS key, CAST(o_orderdate AS DATE) AS day FROM orders",
    "SELECT DISTINCT o_custkey AS key, (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) AS lo, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS hi FROM orders")

SERIES["nearest_place"] = """
WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS place, (p_partkey * 7919) % 18001 / 100.0::DOUBLE - 90.0::DOUBLE AS la, (p_partkey * 104729) % 36001 / 100.0::DOUBLE - 180.0::DOUBLE AS lo FROM part),
c AS (SELECT c_custkey AS key, (c_custkey * 6007) % 18001 / 100.0::DOUBLE - 90.0::DOUBLE AS latitude, (c_custkey * 15013) % 36001 / 100.0::DOUBLE - 180.0::DOUBLE AS longitude FROM customer),
d AS (SELECT key, place, {HAVERSINE} AS km FROM c, r)
SELECT key, arg_min(place, {'km': km, 'place': place}) AS place, round(min(km), 4) AS distance_km FROM d GROUP BY key
"""


def _quantiles(col: str, names: dict[str, float]) -> str:
    return ", ".join(f"round(quantile_cont({col}, {q}), 4) AS {n}" for n, q in names.items())


_FIVE = {"p2_5": 0.025, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p97_5": 0.975}
SERIES["quantiles_by_flag"] = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS column_name, {_quantiles(c, _FIVE)} FROM lineitem GROUP BY l_returnflag" for c in ("l_extendedprice", "l_quantity"))
SERIES["quantiles_all"] = "SELECT 'l_extendedprice' AS column_name, " + \
    _quantiles("l_extendedprice", {"lowest": 0.0, "p0_1": 0.001, "p50": 0.5, "p99_9": 0.999, "highest": 1.0}) + " FROM lineitem"

SERIES["sliced_panel"] = """
SELECT p.key, s.s_name AS name, CAST(p.day AS VARCHAR) AS day, round(CASE WHEN p.temp_count >= 2 THEN p.temp_mean END, 4) AS temp_mean
FROM ({SUPPLIER_PANEL}) p JOIN supplier s ON p.key = s.s_suppkey
WHERE p.day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND month(p.day) <= 5
"""

SERIES["seeded_pick"] = "SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5(concat_ws('|', '42', o_custkey)), o_custkey LIMIT 1"

SERIES["annual_without_last"] = """
WITH a AS (SELECT key, year(day) AS year, coalesce(sum(precip), 0.0) AS annual_sum, count(precip) AS annual_count FROM ({SUPPLIER_PANEL}) GROUP BY 1, 2)
SELECT key, CAST(year AS BIGINT) AS year, round(annual_sum, 4) AS annual_sum, CAST(annual_count AS BIGINT) AS annual_count
FROM (SELECT *, max(year) OVER (PARTITION BY key) AS last FROM a) WHERE year < last
"""

SERIES["zscore_review"] = """
SELECT key, CAST(span_rows AS BIGINT) AS span_rows, round(span_sum, 4) AS span_sum, round(later_mean, 4) AS later_mean,
       round(later_std, 4) AS later_std, round(zscore, 4) AS zscore
FROM ({ZSCORE}) WHERE zscore > 0.5 AND zscore < 2.0
"""

SERIES["category_means"] = """
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS mean_quantity, round(avg(round(l_extendedprice * 100)), 4) AS mean_cents
FROM lineitem GROUP BY 1, 2
"""

SERIES["category_by_year"] = """
SELECT CAST(year(l_shipdate) AS BIGINT) AS year, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 4) AS "total_A",
       round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 4) AS "total_N", round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4) AS "total_R"
FROM lineitem WHERE l_suppkey = 7 GROUP BY 1
"""

SERIES["user_spans"] = """
SELECT user_id, count(value) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
       round(min(value), 4) AS low, round(max(value), 4) AS high, round(count(value) / 8766.0, 4) AS hourly_years
FROM events GROUP BY 1
"""

SERIES["distinct_counts"] = """
SELECT l_returnflag, count(DISTINCT l_suppkey) AS distinct_l_suppkey, count(DISTINCT l_partkey) AS distinct_l_partkey,
       count(DISTINCT l_shipdate) AS distinct_l_shipdate FROM lineitem GROUP BY 1
"""

SERIES["indicator_profile"] = """
WITH x AS (SELECT l_quantity AS v, l_discount > 0.05 OR l_tax > 0.04 AS flag FROM lineitem)
SELECT flag, 'l_quantity' AS column_name, count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min,
       round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS max,
       round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), 4) AS zero_share, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 4) AS null_share
FROM x GROUP BY flag
"""

SERIES["check_counts"] = """SELECT count(*) AS "rows", count(DISTINCT n_name) AS "distinct" FROM nation"""

SERIES["largest_shifts"] = """
SELECT group_id, pair_no, name, q_50 FROM ({SPLICE_REPORT}) WHERE measure = 'value' AND statistic = 'mean' AND q_50 IS NOT NULL
ORDER BY q_50 DESC, group_id, pair_no LIMIT 20
"""

SERIES["ordered_extract"] = """
SELECT o_custkey, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
ORDER BY o_custkey, lineitem.l_shipdate, l_orderkey, lineitem.l_linenumber, l_partkey LIMIT 100
"""

SERIES["near_or_long"] = """
WITH n AS ({NEAREST}),
e AS (SELECT key, date_diff('day', min(day), max(day)) / 365.25 AS duration_years FROM ({SUPPLIER_PANEL}) GROUP BY key)
SELECT n.key, n.nearest_city, round(n.distance_km, 4) AS distance_km, round(e.duration_years, 4) AS duration_years
FROM n JOIN e ON n.key = e.key WHERE n.distance_km <= 150.0 AND e.duration_years >= 6.57
"""

SERIES["coverage_flags"] = """
WITH a AS (SELECT key, year(day) AS yr, count(temp_mean) AS n FROM ({SUPPLIER_PANEL}) GROUP BY 1, 2),
s AS (SELECT key, unnest(generate_series(min(yr), max(yr))) AS yr FROM a GROUP BY key)
SELECT s.key, CAST(make_date(CAST(s.yr AS INTEGER), 1, 1) AS VARCHAR) AS period, CAST(coalesce(n, 0) AS BIGINT) AS count_temp_mean, coalesce(n, 0) > 80.0 AS good
FROM s LEFT JOIN a ON s.key = a.key AND s.yr = a.yr
"""

SERIES["splice_medians"] = """
WITH x AS ({SPLICE_DRAWS}),
st AS (SELECT group_id, pair_no, side, sample, median(value) AS m, max(value) - min(value) AS s FROM x GROUP BY 1, 2, 3, 4),
d AS (SELECT group_id, pair_no, sample, max(CASE WHEN side = 'late' THEN m END) - max(CASE WHEN side = 'early' THEN m END) AS median,
             max(CASE WHEN side = 'late' THEN s END) - max(CASE WHEN side = 'early' THEN s END) AS spread FROM st GROUP BY 1, 2, 3),
l AS (SELECT group_id, pair_no, 'median' AS statistic, median AS v FROM d UNION ALL SELECT group_id, pair_no, 'spread', spread FROM d)
SELECT CAST(group_id AS BIGINT) AS group_id, CAST(pair_no AS BIGINT) AS pair_no, 'value' AS measure, statistic,
       round(quantile_cont(v, 0.025), 4) AS q_2_5, round(quantile_cont(v, 0.5), 4) AS q_50, round(quantile_cont(v, 0.975), 4) AS q_97_5
FROM l GROUP BY 1, 2, 4
"""

SERIES["jitter_hist"] = """
WITH h AS (SELECT l_quantity AS q, md5(concat_ws('|', '11', l_orderkey, l_linenumber, l_partkey)) AS h FROM lineitem),
u AS (SELECT q, ('0x' || h[1:8])::BIGINT / 4294967296.0::DOUBLE AS u1, ('0x' || h[9:16])::BIGINT / 4294967296.0::DOUBLE AS u2 FROM h),
j AS (SELECT (q + (u1 * 0.01::DOUBLE - 0.005::DOUBLE)) * (0.8::DOUBLE + u2 * {JITTER_SPAN}::DOUBLE) AS x FROM u),
y AS (SELECT log10(x) AS v FROM j WHERE x > 0),
r AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 30 AS w FROM y),
c AS (SELECT CAST(least(floor((v - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM y, r GROUP BY 1),
sp AS (SELECT unnest(generate_series(0, 29)) AS bin)
SELECT CAST(sp.bin AS BIGINT) AS bin, round(r.lo + sp.bin * r.w, 4) AS bin_lo, round(r.lo + (sp.bin + 1) * r.w, 4) AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM sp CROSS JOIN r LEFT JOIN c ON sp.bin = c.bin
"""


SERIES["csv_by_header"] = """
SELECT key, CAST(day AS VARCHAR) AS day, round(temp_mean, 4) AS temp_mean, CAST(temp_count AS BIGINT) AS temp_count, round(precip, 4) AS precip
FROM ({SUPPLIER_PANEL})
"""

SERIES["yearly_tables"] = """
SELECT CAST(year(day) AS BIGINT) AS year, count(*) AS n, round(sum(temp_mean + CASE WHEN year(day) = 1997 THEN 1 ELSE 0 END), 4) AS total,
       count(CASE WHEN year(day) = 1997 THEN 1 END) AS checked FROM ({SUPPLIER_PANEL}) WHERE year(day) >= 1996 GROUP BY 1
"""

SERIES["groups_from_file"] = """
SELECT * FROM (SELECT CAST(n_regionkey AS BIGINT) AS group_id, row_number() OVER w - 1 AS pair_no, CAST(n_nationkey AS BIGINT) AS a,
                      CAST(lead(n_nationkey) OVER w AS BIGINT) AS b FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name DESC))
WHERE b IS NOT NULL
"""

SERIES["merged_summaries"] = """
SELECT key, count(*) AS n_rows, count(DISTINCT year(day)) AS n_years, CAST(min(day) AS VARCHAR) AS first_date, CAST(max(day) AS VARCHAR) AS last_date,
       count(temp_mean) AS n_temp_mean, round(avg(temp_mean), 4) AS mean_temp_mean, round(stddev_samp(temp_mean), 4) AS std_temp_mean,
       round(min(temp_mean), 4) AS min_temp_mean, round(max(temp_mean), 4) AS max_temp_mean
FROM ({SUPPLIER_PANEL}) WHERE year(day) BETWEEN 1996 AND 1999 GROUP BY key
"""


_CUSTOMER_STATIONS = """
d AS (SELECT CAST(o_custkey AS VARCHAR) AS usaf, CAST(l_shipdate AS DATE) AS day, CASE WHEN max(l_quantity) >= 10 THEN max(l_quantity) END AS q
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
n AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS b, max(CAST(o_orderdate AS DATE)) AS e FROM orders GROUP BY 1),
s AS (SELECT CAST(o_custkey AS VARCHAR) AS usaf, c_name AS name, n_name AS nearest_city, b, CASE WHEN e > b THEN e END AS e
      FROM n JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT usaf, min(day) AS first_date, max(day) AS last_date, count(*) AS record_count FROM d GROUP BY 1)"""

_AGREEMENT = _CUSTOMER_STATIONS + """,
g AS (SELECT usaf, year(last_date) = 2001 AS operating, first_date, last_date, b, e,
             CASE WHEN coalesce(e < DATE '2001-06-01', false) THEN e ELSE (SELECT max(last_date) FROM x) END AS modified_end
      FROM x JOIN s USING (usaf)),
h AS (SELECT usaf, operating, modified_end, date_diff('day', b, e) AS nominal_days, date_diff('day', first_date, last_date) AS actual_days,
             date_diff('day', b, first_date) AS begin_diff_days, date_diff('day', e, last_date) AS end_diff_days,
             date_diff('day', b, modified_end) - date_diff('day', first_date, last_date) AS modified_diff_days FROM g)"""

SERIES["nominal_agreement"] = f"WITH {_AGREEMENT} SELECT * REPLACE (CAST(modified_end AS VARCHAR) AS modified_end) FROM h"

SERIES["agreement_shares"] = f"""
WITH {_AGREEMENT},
m AS (SELECT operating, median(end_diff_days) AS median_end_diff FROM h GROUP BY 1)
SELECT operating, count(*) AS n_stations, round(max(median_end_diff), 4) AS median_end_diff,
       round(avg(CAST(coalesce(abs(begin_diff_days) > 7, false) AS INTEGER)), 4) AS begin_off_7,
       round(avg(CAST(coalesce(abs(end_diff_days) > 7, false) AS INTEGER)), 4) AS end_off_7,
       round(avg(CAST(coalesce(abs(end_diff_days - median_end_diff) > 7, false) AS INTEGER)), 4) AS end_off_7_from_median,
       round(avg(CAST(coalesce(abs(modified_diff_days) > 7, false) AS INTEGER)), 4) AS duration_off_7,
       round(avg(CAST(coalesce(abs(modified_diff_days) > 365, false) AS INTEGER)), 4) AS duration_off_365,
       round(avg(CAST(coalesce(abs(modified_diff_days) > 1825, false) AS INTEGER)), 4) AS duration_off_1825
FROM h JOIN m USING (operating) GROUP BY 1
"""

_LISTED = "(record_count > 0.1 * 0.8 * 365.25 OR first_date < DATE '1995-02-01')"

SERIES["shortlist"] = f"""
WITH {_CUSTOMER_STATIONS}
SELECT usaf, name, nearest_city, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, record_count,
       round(record_count / (date_diff('day', first_date, last_date) + 1), 4) AS time_coverage
FROM x LEFT JOIN s USING (usaf)
WHERE {_LISTED} AND (starts_with(name, 'Customer#0000000') OR starts_with(name, 'Customer#0000001') OR starts_with(name, 'Customer#00000102'))
  AND name NOT IN ('Customer#000000100', 'Customer#000000007')
"""

SERIES["shortlist_periods"] = f"""
WITH {_CUSTOMER_STATIONS},
k AS (SELECT usaf, date_trunc('month', first_date) AS anchor, name, nearest_city FROM x LEFT JOIN s USING (usaf) WHERE {_LISTED}),
y AS (SELECT usaf, name, nearest_city, CAST(anchor + to_months(CAST(12 * floor(date_diff('month', anchor, date_trunc('month', day)) / 12) AS INTEGER)) AS DATE) AS p,
             count(q) AS count_days FROM d JOIN k USING (usaf) GROUP BY 1, 2, 3, 4)
SELECT usaf, name, nearest_city, CAST(p AS VARCHAR) AS period_start, CAST(CAST(p + INTERVAL 12 MONTH AS DATE) AS VARCHAR) AS period_end, count_days
FROM y WHERE count_days > 0
"""


def series_sql(parts: dict[str, str]) -> dict[str, str]:
    out = {}
    for name, sql in SERIES.items():
        for part, text in parts.items():
            sql = sql.replace("{" + part + "}", text)
        out[name] = sql
    return out
