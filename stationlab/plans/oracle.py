"""SQL oracles (DuckDB dialect) for the registered driver queries.  Same column names, same
normalisation as :func:`stationlab.plans.tidy.tidy`: BIGINT counts, DOUBLE rounded to 4, dates as
ISO text."""

from __future__ import annotations

from ..functions.columns import MIX_FINAL_OFFSETS, MIX_MODULUS, MIX_MULTIPLIER, MIX_OFFSET
from .oracle_series import series_sql

SUPPLIER_PANEL = """
  SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS day,
         round(avg(l_quantity) * 10) AS temp_mean, max(l_quantity) * 10 AS temp_max, min(l_quantity) * 10 AS temp_min,
         count(*) AS temp_count, sum(nullif(round(l_discount * 100), 0.0)) AS precip
  FROM lineitem GROUP BY 1, 2
"""

CUSTOMER_PANEL = """
  SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS day,
         sum(round(o_totalprice * 100)) AS value, count(*) AS n_orders
  FROM orders GROUP BY 1, 2
"""


def r4(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 4) AS {alias}"


def d(expr: str, alias: str) -> str:
    return f"CAST(CAST({expr} AS DATE) AS VARCHAR) AS {alias}"


SQL: dict[str, str] = {}

SQL["extent_coverage"] = f"""
SELECT o_custkey,
       {d('min(o_orderdate)', 'first_date')}, {d('max(o_orderdate)', 'last_date')},
       count(*) AS record_count,
       {r4("count(*) / (date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) + 1)", 'time_coverage')}
FROM orders GROUP BY o_custkey
"""

_A6_COLS = ["temp_mean", "temp_max", "temp_min", "spread", "precip"]
_A6_STATS = {"mean": "avg", "max": "max", "min": "min", "std": "stddev_samp"}
_a6_aggs = ",\n       ".join(f"{fn}({c}) AS {s}_{c}" for c in _A6_COLS for s, fn in _A6_STATS.items())
_a6_out = []
for _c in _A6_COLS:
    for _s in _A6_STATS:
        _e = f"py.{_s}_{_c}"
        if _c == "precip" and _s in ("mean", "max"):
            _e = f"nullif({_e}, 0)"
        _a6_out.append(r4(_e, f"{_s}_{_c}"))
SQL["annual_stats_dense"] = f"""
WITH panel AS ({SUPPLIER_PANEL}),
x AS (SELECT *, temp_max - temp_min AS spread, CASE WHEN temp_min <= 250 THEN 1 ELSE 0 END AS frost FROM panel),
py AS (SELECT key, year(day) AS yr,
       {_a6_aggs},
       sum(frost) AS sum_frost, count(temp_mean) AS count_temp_mean, count(precip) AS count_precip
       FROM x GROUP BY 1, 2),
b AS (SELECT key, min(yr) AS lo, max(yr) AS hi FROM py GROUP BY key),
sp AS (SELECT key, unnest(generate_series(lo, hi)) AS yr FROM b)
SELECT sp.key AS key, CAST(make_date(CAST(sp.yr AS INTEGER), 1, 1) AS VARCHAR) AS period,
       {", ".join(_a6_out)},
       CAST(coalesce(py.sum_frost, 0) AS BIGINT) AS sum_frost,
       CAST(coalesce(py.count_temp_mean, 0) AS BIGINT) AS count_temp_mean,
       CAST(coalesce(py.count_precip, 0) AS BIGINT) AS count_precip,
       coalesce(py.count_temp_mean, 0) > 328.5 AS good_temp_coverage,
       coalesce(py.count_precip, 0) > 328.5 AS good_precip_coverage
FROM sp LEFT JOIN py ON sp.key = py.key AND sp.yr = py.yr
"""

SQL["annual_sum_sparse"] = f"""
WITH panel AS ({SUPPLIER_PANEL})
SELECT key, CAST(year(day) AS BIGINT) AS year, {r4('coalesce(sum(precip), 0.0)', 'annual_sum')},
       count(precip) AS annual_count
FROM panel GROUP BY key, year(day)
"""

SQL["implausible_years"] = f"""
WITH panel AS ({SUPPLIER_PANEL}),
a AS (SELECT key, year(day) AS year, coalesce(sum(precip), 0.0) AS s, count(precip) AS n FROM panel GROUP BY 1, 2)
SELECT key, CAST(year AS BIGINT) AS year FROM a WHERE n >= 60 AND s < 400.0
"""


def _sent(c: str, s: float) -> str:
    return f"CASE WHEN abs({c} - {s!r}) <= {1e-8 + 1e-5 * abs(s)!r} THEN NULL ELSE {c} END"


_SENT = {"l_quantity": 50.0, "l_tax": 0.08, "l_discount": 0.1}
_sent_sel = ", ".join(f"{_sent(c, s)} AS {c}" for c, s in _SENT.items())
SQL["sentinel_null_profile"] = f"""
WITH x AS (SELECT l_returnflag, {_sent_sel} FROM lineitem),
w AS (SELECT l_returnflag, count(*) AS n, {", ".join(f"count({c}) AS nn_{c}" for c in _SENT)} FROM x GROUP BY 1)
""" + "\nUNION ALL\n".join(
    f"SELECT l_returnflag, '{c}' AS column_name, n AS n_rows, n - nn_{c} AS null_count, "
    f"round(CAST(n - nn_{c} AS DOUBLE) / n, 4) AS null_share FROM w" for c in _SENT)

SQL["sentinel_maxima"] = f"""
WITH x AS (SELECT {_sent_sel},
           CASE WHEN CAST(l_quantity AS SMALLINT) = 10 THEN 0 ELSE CAST(l_quantity AS SMALLINT) END AS qty_code
           FROM lineitem)
SELECT round(max(l_quantity), 4) AS max_l_quantity, round(max(l_tax), 4) AS max_l_tax,
       round(max(l_discount), 4) AS max_l_discount, CAST(max(qty_code) AS BIGINT) AS max_qty_code,
       CAST(count(*) FILTER (WHERE qty_code = 0) AS BIGINT) AS n_recoded
FROM x
"""

EXCL_POINTS = """
  SELECT DISTINCT l_suppkey AS key, CAST(l_shipdate AS DATE) AS day FROM lineitem
  WHERE l_returnflag = 'R' AND l_quantity >= 45
"""
EXCL_YEARS = """
  SELECT DISTINCT l_suppkey AS key, year(l_shipdate) AS yr FROM lineitem
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)
"""

SQL["null_points_years"] = f"""
WITH panel AS ({SUPPLIER_PANEL}), pts AS ({EXCL_POINTS}), yrs AS ({EXCL_YEARS})
SELECT p.key, CAST(p.day AS VARCHAR) AS day,
       round(CASE WHEN pts.key IS NULL AND yrs.key IS NULL THEN p.precip END, 4) AS precip,
       round(p.temp_mean, 4) AS temp_mean
FROM panel p LEFT JOIN pts ON p.key = pts.key AND p.day = pts.day
LEFT JOIN yrs ON p.key = yrs.key AND year(p.day) = yrs.yr
"""

_GAP_KEYS = f"""
  SELECT key, count(DISTINCT year(day)) AS years_present FROM ({CUSTOMER_PANEL})
  WHERE year(day) BETWEEN 1995 AND 2000 GROUP BY key HAVING count(DISTINCT year(day)) < 6
"""
SQL["gap_keys"] = f"SELECT key, CAST(years_present AS BIGINT) AS years_present FROM ({_GAP_KEYS})"

SQL["gap_filter"] = f"""
WITH panel AS ({CUSTOMER_PANEL}), g AS ({_GAP_KEYS})
SELECT p.key, CAST(p.day AS VARCHAR) AS day, round(p.value, 4) AS value
FROM panel p LEFT JOIN g ON p.key = g.key
WHERE g.key IS NULL OR p.day >= DATE '1998-01-01'
"""


def _zscore_sql(panel_sql: str, year: int, last_month: int, min_rows: int) -> str:
    return f"""
  WITH zp AS ({panel_sql}),
  py AS (SELECT key, year(day) AS yr, coalesce(sum(precip), 0.0) AS s, count(*) AS n FROM zp
         WHERE month(day) <= {last_month} AND year(day) >= {year} GROUP BY 1, 2),
  span AS (SELECT key, n AS span_rows, s AS span_sum FROM py WHERE yr = {year}),
  later AS (SELECT * FROM py WHERE yr > {year}),
  b AS (SELECT key, min(yr) AS lo, max(yr) AS hi FROM later GROUP BY key),
  sp AS (SELECT key, unnest(generate_series(lo, hi)) AS yr FROM b),
  dense AS (SELECT sp.key, coalesce(later.s, 0.0) AS s FROM sp LEFT JOIN later ON sp.key = later.key AND sp.yr = later.yr),
  st AS (SELECT key, avg(s) AS m, stddev_samp(s) AS sd FROM dense GROUP BY key),
  ks AS (SELECT DISTINCT key FROM zp)
  SELECT ks.key, coalesce(span.span_rows, 0) AS span_rows, span.span_sum, st.m AS later_mean, st.sd AS later_std,
         CASE WHEN coalesce(span.span_rows, 0) >= {min_rows} AND st.sd IS NOT NULL AND st.sd <> 0
              THEN (span.span_sum - st.m) / st.sd END AS zscore
  FROM ks LEFT JOIN span ON ks.key = span.key LEFT JOIN st ON ks.key = st.key
"""


SQL["anomaly_zscore"] = f"""
SELECT key, CAST(span_rows AS BIGINT) AS span_rows, round(span_sum, 4) AS span_sum, round(later_mean, 4) AS later_mean,
       round(later_std, 4) AS later_std, round(zscore, 4) AS zscore
FROM ({_zscore_sql(SUPPLIER_PANEL, 1995, 5, 20)})
"""

SQL["remove_anomalous_span"] = f"""
WITH panel AS ({SUPPLIER_PANEL}), z AS ({_zscore_sql(SUPPLIER_PANEL, 1995, 5, 20)})
SELECT p.key, CAST(p.day AS VARCHAR) AS day, round(p.precip, 4) AS precip
FROM panel p LEFT JOIN (SELECT key FROM z WHERE zscore > 1.0) bad ON p.key = bad.key
WHERE NOT (bad.key IS NOT NULL AND p.day BETWEEN DATE '1995-01-01' AND DATE '1995-05-31')
"""

_RATIO = f"""
  WITH rp AS ({CUSTOMER_PANEL}),
  src AS (SELECT key, day, value FROM rp WHERE year(day) <> 1995),
  m AS (SELECT key, avg(nullif(value, 0.0)) AS key_mean FROM src GROUP BY key)
  SELECT src.key, src.day, src.value, m.key_mean, nullif(src.value, 0.0) / m.key_mean AS ratio
  FROM src JOIN m ON src.key = m.key
"""
SQL["ratio_flags"] = f"""
SELECT key, CAST(day AS VARCHAR) AS day, round(value, 4) AS value, round(key_mean, 4) AS key_mean, round(ratio, 4) AS ratio
FROM ({_RATIO}) WHERE ratio > 2.0
"""

SQL["extreme_neighbourhood"] = f"""
WITH panel AS ({CUSTOMER_PANEL}), ev AS (SELECT key, day AS event_date FROM ({_RATIO}) WHERE ratio > 2.5)
SELECT p.key, CAST(p.day AS VARCHAR) AS day, round(p.value, 4) AS value, CAST(ev.event_date AS VARCHAR) AS event_date
FROM panel p JOIN ev ON p.key = ev.key AND p.day BETWEEN ev.event_date - INTERVAL 183 DAY AND ev.event_date + INTERVAL 183 DAY
"""

SQL["clean_pipeline"] = f"""
WITH panel AS (SELECT key, day, precip, temp_mean FROM ({SUPPLIER_PANEL})),
pts AS ({EXCL_POINTS}), yrs AS ({EXCL_YEARS}),
imp AS (SELECT key, year(day) AS yr FROM panel GROUP BY 1, 2
        HAVING count(precip) >= 60 AND coalesce(sum(precip), 0.0) < 400.0),
nulled AS (
  SELECT p.key, p.day, p.temp_mean,
         CASE WHEN pts.key IS NULL AND yrs.key IS NULL AND imp.key IS NULL THEN p.precip END AS precip
  FROM panel p LEFT JOIN pts ON p.key = pts.key AND p.day = pts.day
  LEFT JOIN yrs ON p.key = yrs.key AND year(p.day) = yrs.yr
  LEFT JOIN imp ON p.key = imp.key AND year(p.day) = imp.yr),
z AS ({_zscore_sql("SELECT * FROM nulled", 1995, 5, 20)}),
despiked AS (
  SELECT n.* FROM nulled n LEFT JOIN (SELECT key FROM z WHERE zscore > 1.0) bad ON n.key = bad.key
  WHERE NOT (bad.key IS NOT NULL AND n.day BETWEEN DATE '1995-01-01' AND DATE '1995-05-31')),
kept AS (SELECT * FROM despiked WHERE key NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)),
gap AS (SELECT key FROM kept WHERE year(day) BETWEEN 1995 AND 2001 GROUP BY key HAVING count(DISTINCT year(day)) < 7)
SELECT k.key, CAST(k.day AS VARCHAR) AS day, round(k.precip, 4) AS precip, round(k.temp_mean, 4) AS temp_mean
FROM kept k LEFT JOIN gap ON k.key = gap.key
WHERE gap.key IS NULL OR k.day >= DATE '1997-01-01'
"""


SUPPLIER_STATIONS = """
  SELECT s_suppkey AS key, s_name, s_acctbal,
         30.0 + CAST((s_suppkey * 7) % 200 AS DOUBLE) / 10.0 AS latitude,
         -125.0 + CAST((s_suppkey * 13) % 200 AS DOUBLE) / 10.0 AS longitude
  FROM supplier
"""
CITIES = """
  SELECT n_name AS city,
         30.0 + CAST((n_nationkey * 17) % 193 AS DOUBLE) / 10.0 AS latitude,
         -125.0 + CAST((n_nationkey * 29) % 193 AS DOUBLE) / 10.0 AS longitude
  FROM nation
"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    p1, p2 = f"radians({lat1})", f"radians({lat2})"
    h = (f"pow(sin(({p2} - {p1}) / 2), 2) + cos({p1}) * cos({p2}) * "
         f"pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)")
    return f"({2 * 6371.0!r} * asin(sqrt(CASE WHEN ({h}) > 1.0 THEN 1.0 ELSE ({h}) END)))"


PAIRS = f"""
  SELECT s.key, c.city, {haversine('s.latitude', 's.longitude', 'c.latitude', 'c.longitude')} AS distance_km
  FROM ({SUPPLIER_STATIONS}) s CROSS JOIN ({CITIES}) c
"""
NEAREST = f"""
  SELECT key, city AS nearest_city, distance_km FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance_km, city) AS rn FROM ({PAIRS})) WHERE rn = 1
"""

SQL["clean_pipeline_stepwise"] = SQL["clean_pipeline"]

SQL["distance_pairs"] = f"SELECT key, city, round(distance_km, 4) AS distance_km FROM ({PAIRS})"
SQL["nearest_city"] = f"SELECT key, nearest_city, round(distance_km, 4) AS distance_km FROM ({NEAREST})"
SQL["near_and_long"] = f"""
WITH n AS ({NEAREST}),
e AS (SELECT key, date_diff('day', min(day), max(day)) / 365.25 AS duration_years FROM ({SUPPLIER_PANEL}) GROUP BY key)
SELECT n.key, n.nearest_city, round(n.distance_km, 4) AS distance_km, round(e.duration_years, 4) AS duration_years
FROM n JOIN e ON n.key = e.key WHERE n.distance_km <= 300.0 AND e.duration_years >= 6.5
"""
SQL["city_members"] = f"SELECT city, key, round(distance_km, 4) AS distance_km FROM ({PAIRS}) WHERE distance_km <= 400.0"

SQL["active_count"] = f"""
WITH e AS (SELECT key, min(day) AS b, max(day) AS e FROM ({CUSTOMER_PANEL}) GROUP BY key),
g AS (SELECT min(b) AS lo, max(e) AS hi FROM e),
s AS (SELECT CASE WHEN day(lo) = 1 THEN lo ELSE date_trunc('month', lo) + INTERVAL 1 MONTH END AS start,
             date_trunc('month', hi) AS stop FROM g),
months AS (SELECT CAST(unnest(generate_series(start, stop, INTERVAL 1 MONTH)) AS DATE) AS month FROM s)
SELECT CAST(m.month AS VARCHAR) AS month, CAST(count(e.key) AS BIGINT) AS active
FROM months m LEFT JOIN e ON e.b <= m.month AND m.month <= e.e
GROUP BY m.month
"""

SQL["bins_12m_anchored"] = f"""
WITH p AS ({CUSTOMER_PANEL}),
a AS (SELECT key, date_trunc('month', min(day)) AS anchor FROM p GROUP BY key),
x AS (SELECT p.key, p.value, a.anchor,
             CAST(floor(date_diff('month', a.anchor, date_trunc('month', p.day)) / 12) AS INTEGER) AS n
      FROM p JOIN a ON p.key = a.key),
y AS (SELECT key, CAST(anchor + to_months(12 * n) AS DATE) AS period_start, count(value) AS count_days FROM x GROUP BY 1, 2)
SELECT key, CAST(period_start AS VARCHAR) AS period_start, CAST(CAST(period_start + INTERVAL 12 MONTH AS DATE) AS VARCHAR) AS period_end,
       CAST(count_days AS BIGINT) AS count_days
FROM y WHERE count_days > 0
"""

SQL["bins_7d_anchored"] = """
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, value FROM events),
f AS (SELECT user_id, min(d) AS first FROM e GROUP BY user_id)
SELECT e.user_id, CAST(CAST(f.first + CAST(7 * floor(date_diff('day', f.first, e.d) / 7) AS INTEGER) AS DATE) AS VARCHAR) AS period_start,
       round(max(e.value), 4) AS max_value
FROM e JOIN f ON e.user_id = f.user_id GROUP BY 1, 2
"""

SQL["bins_365d_end"] = f"""
WITH p AS ({SUPPLIER_PANEL}),
l AS (SELECT key, max(day) AS last FROM p GROUP BY key),
m AS (SELECT p.key, CAST(floor(date_diff('day', p.day, l.last) / 365) AS BIGINT) AS bin, avg(p.temp_mean) AS mean_temp
      FROM p JOIN l ON p.key = l.key GROUP BY 1, 2),
sp AS (SELECT key, unnest(generate_series(0, max(bin))) AS bin FROM m GROUP BY key)
SELECT sp.key, CAST(sp.bin AS BIGINT) AS bin, round(m.mean_temp, 4) AS mean_temp
FROM sp LEFT JOIN m ON sp.key = m.key AND sp.bin = m.bin
"""

SQL["daily_grid"] = """
WITH pd AS (SELECT user_id, CAST(ts AS DATE) AS day, count(value) AS n FROM events GROUP BY 1, 2),
b AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM pd GROUP BY 1),
sp AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT sp.user_id, CAST(sp.day AS VARCHAR) AS day, CAST(CASE WHEN coalesce(pd.n, 0) > 0 THEN 0 ELSE 1 END AS BIGINT) AS missing
FROM sp LEFT JOIN pd ON sp.user_id = pd.user_id AND sp.day = pd.day
"""

SQL["all_keys_grid"] = """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(round(value * 100)) AS total FROM events GROUP BY 1, 2),
g AS (SELECT min(day) AS lo, max(day) AS hi FROM d),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM g),
u AS (SELECT DISTINCT user_id FROM d)
SELECT u.user_id, CAST(days.day AS VARCHAR) AS day, round(d.total, 4) AS total
FROM u CROSS JOIN days LEFT JOIN d ON d.user_id = u.user_id AND d.day = days.day
"""

SQL["daily_sum_filled"] = """
WITH pd AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(round(value * 100)) AS s FROM events GROUP BY 1, 2),
b AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM pd GROUP BY 1),
sp AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT sp.user_id, CAST(sp.day AS VARCHAR) AS day, round(coalesce(pd.s, 0.0), 4) AS daily_total
FROM sp LEFT JOIN pd ON sp.user_id = pd.user_id AND sp.day = pd.day
"""

SQL["annual_median"] = """
WITH o AS (SELECT o_orderstatus, year(o_orderdate) AS yr,
                  CASE substr(regexp_replace(o_orderpriority, '[^A-Z]', '', 'g'), 1, 1)
                    WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'D' THEN 3 WHEN 'E' THEN 4
                    WHEN 'F' THEN 5 WHEN 'G' THEN 6 WHEN 'H' THEN 7 WHEN 'I' THEN 8 END AS code
           FROM orders),
py AS (SELECT o_orderstatus, yr, median(code) AS median_code FROM o GROUP BY 1, 2),
b AS (SELECT o_orderstatus, min(yr) AS lo, max(yr) AS hi FROM py GROUP BY 1),
sp AS (SELECT o_orderstatus, unnest(generate_series(lo, hi)) AS yr FROM b)
SELECT sp.o_orderstatus, CAST(make_date(CAST(sp.yr AS INTEGER), 1, 1) AS VARCHAR) AS period,
       round(CAST(py.median_code AS DOUBLE), 4) AS median_code
FROM sp LEFT JOIN py ON sp.o_orderstatus = py.o_orderstatus AND sp.yr = py.yr
"""

SQL["semi_keep"] = """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
"""
SQL["anti_drop"] = f"""
SELECT key, CAST(day AS VARCHAR) AS day, round(value, 4) AS value FROM ({CUSTOMER_PANEL})
WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
"""
SQL["union_filter"] = """
SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer
WHERE (c_mktsegment = 'BUILDING' AND CAST(c_nationkey AS VARCHAR) IN ('1', '2', '3'))
   OR (c_mktsegment = 'MACHINERY' AND c_acctbal < 0.0 AND c_nationkey < 10.0)
"""
SQL["distinct_keys"] = """
SELECT DISTINCT o_custkey AS key FROM (
  SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995
  UNION ALL SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001)
"""
SQL["prefix_match"] = """
SELECT p_partkey, p_name FROM part
WHERE starts_with(trim(p_name), 'small') OR starts_with(trim(p_name), 'red w')
   OR starts_with(trim(p_name), 'blue') OR starts_with(trim(p_name), 'hot r')
"""
SQL["contains_text"] = "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')"


SQL["describe_numeric"] = """
WITH e AS (SELECT event_type, round(value * 100) AS cents FROM events)
SELECT event_type, 'cents' AS column_name, count(cents) AS count, round(avg(cents), 4) AS mean,
       round(stddev_samp(cents), 4) AS std, round(min(cents), 4) AS min,
       round(quantile_cont(cents, 0.25), 4) AS p25, round(quantile_cont(cents, 0.5), 4) AS p50,
       round(quantile_cont(cents, 0.75), 4) AS p75, round(max(cents), 4) AS max
FROM e GROUP BY event_type
"""
SQL["describe_text"] = """
WITH vc AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
            WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2)
SELECT o_orderstatus, CAST(sum(n) AS BIGINT) AS n_values, count(*) AS n_unique,
       first(o_orderpriority ORDER BY n DESC, o_orderpriority) AS top, max(n) AS freq
FROM vc GROUP BY o_orderstatus
"""
SQL["value_counts"] = """
SELECT l_returnflag, l_linestatus, count(*) AS "count",
       round(count(*) / sum(count(*)) OVER (), 4) AS share
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2
"""
SQL["null_share"] = """
SELECT l_returnflag,
       round(avg(CASE WHEN coalesce(l_discount = 0, false) THEN 1.0 ELSE 0.0 END), 4) AS zero_share,
       round(avg(CASE WHEN nullif(l_discount, 0.0) IS NULL THEN 1.0 ELSE 0.0 END), 4) AS null_share,
       round(avg(CASE WHEN coalesce(l_quantity > 45, false) THEN 1.0 ELSE 0.0 END), 4) AS big_share
FROM lineitem GROUP BY l_returnflag
"""
SQL["histogram"] = """
WITH x AS (SELECT l_linestatus, CAST(l_quantity AS DOUBLE) AS v FROM lineitem WHERE l_quantity IS NOT NULL),
c AS (SELECT l_linestatus, CAST(least(floor((v - 1.0) / 7.0), 6) AS INTEGER) AS bin, count(*) AS n
      FROM x WHERE v >= 1.0 AND v <= 50.0 GROUP BY 1, 2),
sp AS (SELECT l_linestatus, unnest(generate_series(0, 6)) AS bin FROM (SELECT DISTINCT l_linestatus FROM c)),
d AS (SELECT sp.l_linestatus, sp.bin, coalesce(c.n, 0) AS n FROM sp LEFT JOIN c ON sp.l_linestatus = c.l_linestatus AND sp.bin = c.bin)
SELECT l_linestatus, CAST(bin AS BIGINT) AS bin, round(CAST(1.0 + bin * 7.0 AS DOUBLE), 4) AS bin_lo, round(CAST(1.0 + (bin + 1) * 7.0 AS DOUBLE), 4) AS bin_hi,
       CAST(n AS BIGINT) AS count, round(n / (sum(n) OVER (PARTITION BY l_linestatus) * 7.0), 4) AS density
FROM d
"""
SQL["histogram_log"] = """
WITH x AS (SELECT CASE WHEN CAST(l_extendedprice AS DOUBLE) > 0 THEN log10(CAST(l_extendedprice AS DOUBLE)) END AS v FROM lineitem),
y AS (SELECT v FROM x WHERE v IS NOT NULL),
r AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 20 AS w FROM y),
c AS (SELECT CAST(least(floor((v - lo) / w), 19) AS INTEGER) AS bin, count(*) AS n FROM y, r
      WHERE v >= lo AND v <= hi GROUP BY 1),
sp AS (SELECT unnest(generate_series(0, 19)) AS bin)
SELECT CAST(sp.bin AS BIGINT) AS bin, round(r.lo + sp.bin * r.w, 4) AS bin_lo, round(r.lo + (sp.bin + 1) * r.w, 4) AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM sp CROSS JOIN r LEFT JOIN c ON sp.bin = c.bin
"""
SQL["ecdf"] = """
WITH x AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS v FROM lineitem WHERE l_quantity IS NOT NULL),
c AS (SELECT l_returnflag, CAST(least(floor((v - 0.0) / 5.0), 9) AS INTEGER) AS bin, count(*) AS n
      FROM x WHERE v >= 0.0 AND v <= 50.0 GROUP BY 1, 2),
sp AS (SELECT l_returnflag, unnest(generate_series(0, 9)) AS bin FROM (SELECT DISTINCT l_returnflag FROM c)),
d AS (SELECT sp.l_returnflag, sp.bin, coalesce(c.n, 0) AS n FROM sp LEFT JOIN c ON sp.l_returnflag = c.l_returnflag AND sp.bin = c.bin)
SELECT l_returnflag, CAST(bin AS BIGINT) AS bin, round(CAST(bin * 5.0 AS DOUBLE), 4) AS bin_lo, round(CAST((bin + 1) * 5.0 AS DOUBLE), 4) AS bin_hi,
       CAST(n AS BIGINT) AS count,
       round(CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
             / sum(n) OVER (PARTITION BY l_returnflag), 4) AS cum_share
FROM d
"""
SQL["fraction_over"] = """
SELECT o_orderstatus,
       round(avg(CASE WHEN coalesce(o_totalprice > 200000, false) THEN 1.0 ELSE 0.0 END), 4) AS share_big,
       round(avg(CASE WHEN coalesce(o_orderpriority = '1-URGENT', false) THEN 1.0 ELSE 0.0 END), 4) AS share_urgent
FROM orders GROUP BY o_orderstatus
"""
SQL["nominal_vs_actual"] = """
WITH n AS (SELECT l_suppkey AS key, min(CAST(o_orderdate AS DATE)) AS nominal_begin, max(CAST(o_orderdate AS DATE)) AS nominal_end
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
e AS (SELECT l_suppkey AS key, min(CAST(l_shipdate AS DATE)) AS first_date, max(CAST(l_shipdate AS DATE)) AS last_date,
             count(*) AS record_count FROM lineitem GROUP BY 1),
g AS (SELECT max(CAST(l_shipdate AS DATE)) AS last_all FROM lineitem)
SELECT n.key, CAST(nominal_begin AS VARCHAR) AS nominal_begin, CAST(nominal_end AS VARCHAR) AS nominal_end,
       CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, record_count,
       CAST(date_diff('day', nominal_begin, nominal_end) AS BIGINT) AS nominal_days,
       CAST(date_diff('day', first_date, last_date) AS BIGINT) AS actual_days,
       CAST(date_diff('day', nominal_begin, first_date) AS BIGINT) AS begin_diff_days,
       CAST(date_diff('day', nominal_end, last_date) AS BIGINT) AS end_diff_days,
       CAST(date_diff('day', first_date, last_date) - date_diff('day', nominal_begin, nominal_end) AS BIGINT) AS duration_diff_days,
       CAST(CASE WHEN coalesce(nominal_end < DATE '2001-06-01', false) THEN nominal_end ELSE g.last_all END AS VARCHAR) AS capped_end
FROM n JOIN e ON n.key = e.key CROSS JOIN g
"""
CITY_YEAR = f"""
  WITH p AS ({SUPPLIER_PANEL}),
  a AS (SELECT key, make_date(CAST(year(day) AS INTEGER), 1, 1) AS period, avg(temp_mean) AS m, count(temp_mean) AS n
        FROM p GROUP BY 1, 2),
  q AS (SELECT a.*, CASE WHEN n > 60.0 THEN m END AS qc FROM a)
  SELECT n_name AS city, period, avg(qc) AS city_mean, year(period) AS year
  FROM q JOIN supplier ON q.key = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY n_name, period
"""
SQL["group_trend"] = f"""
SELECT city, round(regr_slope(city_mean, CAST(year AS DOUBLE)), 4) AS slope,
       round(regr_intercept(city_mean, CAST(year AS DOUBLE)), 4) AS intercept,
       CAST(regr_count(city_mean, CAST(year AS DOUBLE)) AS BIGINT) AS n_points
FROM ({CITY_YEAR}) GROUP BY city
"""
SQL["group_corr"] = f"""
WITH x AS (SELECT city, period, avg(city_mean) AS v FROM ({CITY_YEAR}) WHERE city_mean IS NOT NULL GROUP BY 1, 2)
SELECT a.city AS group_a, b.city AS group_b, round(corr(a.v, b.v), 4) AS corr, count(*) AS n_common
FROM x a JOIN x b ON a.period = b.period GROUP BY 1, 2
"""
SQL["centered"] = f"""
WITH c AS ({CITY_YEAR}), b AS (SELECT city, max(city_mean) AS base FROM c WHERE period = DATE '1996-01-01' GROUP BY city)
SELECT c.city, CAST(c.period AS VARCHAR) AS period, round(c.city_mean - b.base, 4) AS centered
FROM c LEFT JOIN b ON c.city = b.city
"""
SQL["normalised"] = f"""
WITH c AS ({CITY_YEAR}), m AS (SELECT city, max(city_mean) AS mx FROM c GROUP BY city)
SELECT c.city, CAST(c.period AS VARCHAR) AS period, round(c.city_mean / nullif(m.mx, 0), 4) AS normalised
FROM c LEFT JOIN m ON c.city = m.city
"""
SQL["top_k"] = """
SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 5
"""
SQL["top_k_by_group"] = """
SELECT o_orderkey, o_orderpriority, round(o_totalprice, 4) AS o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
WHERE rn <= 3
"""
SQL["row_at_max"] = """
SELECT o_orderstatus, o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
WHERE rn = 1
"""
SQL["longest_by_group"] = f"""
WITH e AS (SELECT key, count(*) / 365.25 AS years FROM ({CUSTOMER_PANEL}) GROUP BY key)
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, round(max(years), 4) AS best
FROM e JOIN customer ON e.key = c_custkey GROUP BY c_nationkey
"""
SQL["cross_field_checks"] = f"""
WITH p AS ({SUPPLIER_PANEL})
SELECT count(*) AS "rows",
       bool_or(coalesce(temp_min > temp_mean, false)) AS any_min_gt_mean,
       count(*) FILTER (WHERE coalesce(temp_min > temp_mean, false)) AS n_min_gt_mean,
       bool_or(coalesce(temp_mean > temp_max, false)) AS any_mean_gt_max,
       count(*) FILTER (WHERE coalesce(temp_mean > temp_max, false)) AS n_mean_gt_max,
       bool_or(coalesce(temp_mean < precip, false)) AS any_mean_lt_precip,
       count(*) FILTER (WHERE coalesce(temp_mean < precip, false)) AS n_mean_lt_precip
FROM p
"""
SQL["pressure_rule"] = """
SELECT l_tax < l_discount AS violates, count(*) AS "count"
FROM lineitem WHERE NOT coalesce(l_discount < 0.02, false) AND l_discount IS NOT NULL AND (l_tax < l_discount) IS NOT NULL
GROUP BY 1
"""
SQL["duplicates"] = "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM lineitem"
SQL["resolution_profile"] = f"""
WITH d AS (SELECT key, CAST(max(temp_count) AS DOUBLE) AS mx, quantile_cont(CAST(temp_count AS DOUBLE), 0.75) AS p75,
                  CAST(min(temp_count) AS DOUBLE) AS mn FROM ({SUPPLIER_PANEL}) GROUP BY key),
l AS (SELECT 'max' AS statistic, mx AS value FROM d UNION ALL SELECT 'p75', p75 FROM d UNION ALL SELECT 'min', mn FROM d)
SELECT statistic, round(value, 4) AS value, count(*) AS "count" FROM l WHERE value IS NOT NULL GROUP BY 1, 2
"""
SQL["filtered_coverage"] = f"""
SELECT key, count(CASE WHEN temp_count >= 2 THEN temp_mean END) AS kept,
       round(count(CASE WHEN temp_count >= 2 THEN temp_mean END) / (date_diff('day', min(day), max(day)) + 1.0), 4) AS filtered_coverage
FROM ({SUPPLIER_PANEL}) GROUP BY key
"""
SQL["operating"] = f"""
SELECT key, CAST(max(day) AS VARCHAR) AS last_date, year(max(day)) = 2001 AS operating
FROM ({CUSTOMER_PANEL}) GROUP BY key
"""
SQL["pivot_wide"] = "SELECT l_returnflag, " + ", ".join(
    f"round(sum(l_quantity) FILTER (WHERE year(l_shipdate) = {y}), 4) AS y{y}" for y in range(1995, 2002)
) + " FROM lineitem GROUP BY l_returnflag"
SQL["unpivot_long"] = "SELECT l_returnflag, year, qty FROM (" + " UNION ALL ".join(
    f"SELECT l_returnflag, CAST({y} AS BIGINT) AS year, round(sum(l_quantity) FILTER (WHERE year(l_shipdate) = {y}), 4) AS qty "
    f"FROM lineitem GROUP BY l_returnflag" for y in range(1995, 2002)) + ")"


SPLICE_YEARS = 10
SPLICE_SAMPLES = 2000
SPLICE_SEED = 7

SPLICE_PAIRS = """
  SELECT * FROM (
    SELECT c_nationkey AS group_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pair_no, c_custkey AS a_key,
           lead(c_custkey) OVER w AS b_key
    FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey, c_custkey)) WHERE b_key IS NOT NULL
"""
SQL["splice_pairs"] = f"SELECT CAST(group_id AS BIGINT) AS group_id, CAST(pair_no AS BIGINT) AS pair_no, a_key, b_key FROM ({SPLICE_PAIRS})"

SPLICE_ORDER = f"""
  WITH pr AS ({SPLICE_PAIRS}),
  mem AS (SELECT group_id, pair_no, 0 AS member, a_key AS key FROM pr UNION ALL
          SELECT group_id, pair_no, 1 AS member, b_key AS key FROM pr),
  ext AS (SELECT key, min(day) AS first_date, max(day) AS last_date FROM ({CUSTOMER_PANEL}) GROUP BY key),
  m AS (SELECT mem.*, ext.last_date,
               row_number() OVER (PARTITION BY group_id, pair_no ORDER BY last_date, member) - 1 AS rnk
        FROM mem JOIN ext ON mem.key = ext.key)
  SELECT group_id, pair_no, max(CASE WHEN rnk = 0 THEN member END) AS early_member,
         min(CASE WHEN rnk = 0 THEN last_date END) AS splice_date, min(last_date) = max(last_date) AS tie
  FROM m GROUP BY group_id, pair_no HAVING count(*) = 2
"""
SQL["splice_order"] = f"""
SELECT CAST(group_id AS BIGINT) AS group_id, CAST(pair_no AS BIGINT) AS pair_no, CAST(early_member AS BIGINT) AS early_member,
       CAST(splice_date AS VARCHAR) AS splice_date, tie FROM ({SPLICE_ORDER})
"""

SQL["lookup_date"] = f"""
WITH p AS ({CUSTOMER_PANEL})
SELECT key, '1998-01-01' AS target,
       CAST(min(CASE WHEN day >= DATE '1998-01-01' THEN day END) AS VARCHAR) AS bfill_date,
       CAST(max(CASE WHEN day <= DATE '1998-01-01' THEN day END) AS VARCHAR) AS ffill_date,
       CAST(first(day ORDER BY abs(date_diff('day', DATE '1998-01-01', day)), day) AS VARCHAR) AS nearest_date
FROM p GROUP BY key
"""

SPLICE_BINS = f"""
  WITH o AS ({SPLICE_ORDER}), pr AS ({SPLICE_PAIRS}),
  mem AS (SELECT group_id, pair_no, 0 AS member, a_key AS key FROM pr UNION ALL
          SELECT group_id, pair_no, 1 AS member, b_key AS key FROM pr),
  r0 AS (SELECT mem.group_id, mem.pair_no, CASE WHEN mem.member = o.early_member THEN 'early' ELSE 'late' END AS side,
                p.day, ln(p.value) AS value, ln(p.n_orders + 1) AS n_orders, o.splice_date
         FROM mem JOIN ({CUSTOMER_PANEL}) p ON mem.key = p.key
         JOIN o ON mem.group_id = o.group_id AND mem.pair_no = o.pair_no),
  r1 AS (SELECT * FROM r0 WHERE side = 'early' OR day >= splice_date),
  e1 AS (SELECT group_id, pair_no, side, min(day) AS lo, max(day) AS hi FROM r1 GROUP BY 1, 2, 3),
  r2 AS (SELECT r1.* FROM r1 JOIN e1 USING (group_id, pair_no, side)
         WHERE CASE WHEN side = 'early' THEN day >= hi - INTERVAL {SPLICE_YEARS * 365 - 1} DAY
                    ELSE day <= lo + INTERVAL {SPLICE_YEARS * 365 - 1} DAY END),
  a AS (SELECT group_id, pair_no, side, max(day) AS anchor, min(day) AS first FROM r2 GROUP BY 1, 2, 3),
  mb AS (SELECT r2.group_id, r2.pair_no, r2.side, CAST(floor(date_diff('day', r2.day, a.anchor) / 365) AS INTEGER) AS bin,
                avg(r2.value) AS value, avg(r2.n_orders) AS n_orders
         FROM r2 JOIN a USING (group_id, pair_no, side) GROUP BY 1, 2, 3, 4),
  nb AS (SELECT a.*, CAST(floor(date_diff('day', first, anchor) / 365) AS INTEGER) + 1 AS n_bins FROM a),
  sp AS (SELECT group_id, pair_no, side, n_bins, anchor, unnest(generate_series(0, n_bins - 1)) AS bin FROM nb)
  SELECT sp.group_id, sp.pair_no, sp.side, sp.bin, CAST(sp.anchor - INTERVAL (sp.bin * 365) DAY AS DATE) AS bin_end,
         sp.n_bins, mb.value, mb.n_orders
  FROM sp LEFT JOIN mb ON sp.group_id = mb.group_id AND sp.pair_no = mb.pair_no AND sp.side = mb.side AND sp.bin = mb.bin
"""
SQL["splice_windows"] = f"""
SELECT CAST(group_id AS BIGINT) AS group_id, CAST(pair_no AS BIGINT) AS pair_no, side, CAST(bin AS BIGINT) AS bin,
       CAST(bin_end AS VARCHAR) AS bin_end, CAST(n_bins AS BIGINT) AS n_bins, round(value, 4) AS value,
       round(n_orders, 4) AS n_orders
FROM ({SPLICE_BINS})
"""

# Draw index as in functions.columns.hash_seed / mix_round / mix_draw
_P, _MUL, _OFF, _FIN = MIX_MODULUS, MIX_MULTIPLIER, MIX_OFFSET, MIX_FINAL_OFFSETS
_SIDE_STATE = (f"(CAST(('0x' || substr(md5(concat_ws('|', '{SPLICE_SEED}', group_id, pair_no, side)), 1, 8)) AS BIGINT)"
               f" % {_P})")


def _mix_sql(h: str, v: str | None, offset: int = _OFF) -> str:
    step = f"({h} * {h}) % {_P} + {offset}"
    if v is not None:
        step += f" + ({v} % {_P}) * {_MUL}"
    return f"(({step}) % {_P})"


SPLICE_DRAWS = f"""
  WITH b AS ({SPLICE_BINS}),
  sd AS (SELECT DISTINCT group_id, pair_no, side, n_bins FROM b),
  sh AS (SELECT sd.*, {_SIDE_STATE} AS h0 FROM sd),
  dr AS (SELECT sh.*, s.sample, d.draw FROM sh,
         (SELECT unnest(generate_series(1, {SPLICE_SAMPLES})) AS sample) s,
         LATERAL (SELECT unnest(generate_series(0, sh.n_bins - 1)) AS draw) d),
  m1 AS (SELECT dr.*, {_mix_sql("h0", "sample")} AS h1 FROM dr),
  m2 AS (SELECT m1.*, {_mix_sql("h1", "draw")} AS h2 FROM m1),
  m3 AS (SELECT m2.*, {_mix_sql("h2", None, _FIN[0])} AS h3 FROM m2),
  m4 AS (SELECT m3.*, {_mix_sql("h3", None, _FIN[1])} AS h4 FROM m3),
  di AS (SELECT m4.*, h4 % n_bins AS bin2 FROM m4)
  SELECT di.group_id, di.pair_no, di.side, di.sample, b.value, b.n_orders
        FROM di LEFT JOIN b ON di.group_id = b.group_id AND di.pair_no = b.pair_no AND di.side = b.side AND di.bin2 = b.bin
"""
SPLICE_DIFF = f"""
  WITH x AS ({SPLICE_DRAWS}),
  st AS (SELECT group_id, pair_no, side, sample, avg(value) AS vm, stddev_samp(value) AS vs,
                avg(n_orders) AS nm, stddev_samp(n_orders) AS ns FROM x GROUP BY 1, 2, 3, 4)
  SELECT group_id, pair_no, sample,
         max(CASE WHEN side = 'late' THEN vm END) - max(CASE WHEN side = 'early' THEN vm END) AS value__mean,
         max(CASE WHEN side = 'late' THEN vs END) - max(CASE WHEN side = 'early' THEN vs END) AS value__std,
         max(CASE WHEN side = 'late' THEN nm END) - max(CASE WHEN side = 'early' THEN nm END) AS n_orders__mean,
         max(CASE WHEN side = 'late' THEN ns END) - max(CASE WHEN side = 'early' THEN ns END) AS n_orders__std
  FROM st GROUP BY 1, 2, 3
"""
SQL["splice_diff"] = f"""
SELECT CAST(group_id AS BIGINT) AS group_id, CAST(pair_no AS BIGINT) AS pair_no, CAST(sample AS BIGINT) AS sample,
       round(value__mean, 4) AS value__mean, round(value__std, 4) AS value__std,
       round(n_orders__mean, 4) AS n_orders__mean, round(n_orders__std, 4) AS n_orders__std
FROM ({SPLICE_DIFF})
"""
_SPLICE_CI = f"""
WITH d AS ({SPLICE_DIFF}),
l AS (SELECT group_id, pair_no, 'value' AS measure, 'mean' AS statistic, value__mean AS v FROM d UNION ALL
      SELECT group_id, pair_no, 'value', 'std', value__std FROM d UNION ALL
      SELECT group_id, pair_no, 'n_orders', 'mean', n_orders__mean FROM d UNION ALL
      SELECT group_id, pair_no, 'n_orders', 'std', n_orders__std FROM d)
SELECT CAST(group_id AS BIGINT) AS group_id, CAST(pair_no AS BIGINT) AS pair_no, measure, statistic,
       round(quantile_cont(v, 0.025), 4) AS q_2_5, round(quantile_cont(v, 0.5), 4) AS q_50,
       round(quantile_cont(v, 0.975), 4) AS q_97_5
FROM l GROUP BY 1, 2, 3, 4
"""


SQL["splice_bootstrap"] = _SPLICE_CI
SQL["splice_report"] = f"""
SELECT r.*, c.c_name AS name FROM ({_SPLICE_CI}) r
JOIN ({SPLICE_PAIRS}) p ON r.group_id = p.group_id AND r.pair_no = p.pair_no LEFT JOIN customer c ON c.c_custkey = p.a_key
"""


def _positive_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(0.0 + round(...))``: DuckDB keeps the sign of a rounded
    tiny negative (-0.0) where Spark returns 0.0, and IEEE addition of +0.0 clears it."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        out.append("(0.0 + round(" + _positive_zero(sql[j + len(key):k]) + "))")
        i = k + 1


SQL |= series_sql({
    "SUPPLIER_PANEL": SUPPLIER_PANEL, "CUSTOMER_PANEL": CUSTOMER_PANEL, "NEAREST": NEAREST, "ZSCORE": _zscore_sql(SUPPLIER_PANEL, 1995, 5, 20),
    "HAVERSINE": haversine("latitude", "longitude", "la", "lo"), "SPLICE_REPORT": SQL["splice_report"], "SPLICE_DRAWS": SPLICE_DRAWS,
    "JITTER_SPAN": repr(1.2 - 0.8),
})
SQL = {name: _positive_zero(q) for name, q in SQL.items()}
