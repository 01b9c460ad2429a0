"""The quality report's agreement tables and the shortlist against plain Python."""

import datetime as dt
import random
import statistics

from stationlab.plans import pipelines as L

D = dt.date


def _data(spark):
    rng = random.Random(11)
    rows, stations = [], []
    for i in range(40):
        key, start = f"k{i:02d}", D(1990, 1, 1) + dt.timedelta(days=rng.randint(0, 4000))
        n = 900 if i == 0 else rng.randint(1, 40)       # one station holds half of all rows
        days = sorted(rng.sample(range(2500 if i % 3 else 400), n if i else 400))
        rows += [(key, "9", start + dt.timedelta(days=d), None if rng.random() < 0.3 else float(d)) for d in days]
        end = None if i % 7 == 0 else start + dt.timedelta(days=days[-1] + rng.choice([0, 3, 30, 500]))
        stations.append((key, "9", None if i % 11 == 0 else f" NAME {i:02d} ", "city", None if i % 13 == 5 else start, end))
    stations.append(("none", "9", "no rows", "city", D(1990, 1, 1), D(1991, 1, 1)))
    daily = spark.createDataFrame(rows, "usaf string, wban string, timestamp date, temp_f_mean double")
    meta = spark.createDataFrame(stations, "usaf string, wban string, name string, nearest_city string, "
                                           "nominal_begin_date date, nominal_end_date date")
    return daily, meta, rows, stations


def _spans(rows):
    out = {}
    for k, _, d, _ in rows:
        lo, hi, n = out.get(k, (d, d, 0))
        out[k] = min(lo, d), max(hi, d), n + 1
    return out


def test_agreement_against_python(spark):
    daily, meta, rows, stations = _data(spark)
    spans, cutoff, year = _spans(rows), D(2000, 1, 1), max(r[2] for r in rows).year
    last = max(hi for _, hi, _ in spans.values())
    want = {}
    for k, _, _, _, b, e in stations:
        if k in spans:
            lo, hi, _ = spans[k]
            repaired = e if e and e < cutoff else last
            want[k] = (hi.year == year, repaired, None if b is None else (lo - b).days, None if e is None else (hi - e).days,
                       None if b is None else (repaired - b).days - (hi - lo).days)
    x = L.nominal_agreement(daily, meta, year, "2000-01-01")
    assert {r.usaf: (r.operating, r.modified_end, r.begin_diff_days, r.end_diff_days, r.modified_diff_days) for r in x.collect()} == want
    got = {r.operating: r for r in L.agreement_shares(x).collect()}
    for op in {w[0] for w in want.values()}:
        part = [w for w in want.values() if w[0] == op]
        ends = [w[3] for w in part if w[3] is not None]
        assert got[op].n_stations == len(part)
        assert got[op].median_end_diff == (statistics.median(ends) if ends else None)
        for name, i, limit in (("begin_off_7", 2, 7), ("end_off_7", 3, 7), ("duration_off_365", 4, 365)):
            assert abs(got[op][name] - sum(w[i] is not None and abs(w[i]) > limit for w in part) / len(part)) < 1e-12


def test_shortlist_against_python(spark):
    daily, meta, rows, stations = _data(spark)
    spans, facts = _spans(rows), {s[0]: s for s in stations}
    prefixes = spark.createDataFrame([("NAME 0",), ("NAME 1",), ("NAME 12",), (None,)], "prefix string")
    got = L.shortlist(daily, meta, 0.05, "1992-01-01", prefixes, [" NAME 03 "])
    want = {k for k, (lo, hi, n) in spans.items() if n > 0.05 * 0.8 * 365.25 or lo < D(1992, 1, 1)}
    want = {k for k in want if facts[k][2] and facts[k][2].strip()[:6] in ("NAME 0", "NAME 1") and facts[k][2] != " NAME 03 "}
    assert {r.usaf for r in got.collect()} == want and want
    periods = {}
    for k, _, d, v in rows:
        if k in want and v is not None:
            lo = spans[k][0]
            n = ((d.year - lo.year) * 12 + d.month - lo.month) // 12
            at = (k, D(lo.year + n, lo.month, 1))
            periods[at] = periods.get(at, 0) + 1
    assert {(r.usaf, r.period_start): r.count_days for r in L.shortlist_periods(daily, got).collect()} == periods


def test_report_of_nothing(spark):
    daily, meta, _, _ = _data(spark)
    x = L.nominal_agreement(daily.limit(0), meta)
    assert x.count() == 0 and L.agreement_shares(x).count() == 0
    assert L.shortlist(daily.limit(0), meta).count() == 0
    assert L.coverage_shares(L.shortlist(daily, meta, 0.0), "time_coverage").first().from_90_pct >= 0
