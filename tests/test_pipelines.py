"""End-to-end runs of the station pipelines on a small synthetic export (same shapes as the
real files, invented values)."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest

from stationlab.plans import pipelines as L
from stationlab.sources import readers as R

HEADER = ("stn,wban,year,mo,da,temp,count_temp,dewp,count_dewp,slp,count_slp,stp,count_stp,visib,count_visib,"
          "wdsp,count_wdsp,max,flag_max,min,flag_min,prcp,flag_prcp,sndp,rain_drizzle,snow_ice_pellets,hail")
STATIONS = [("722740", "23160", "ALPHA AP", 32.1, -110.9, "1968-01-01", "1981-12-31"),
            ("722745", "99999", "ALPHA OLD", 32.2, -110.8, "1968-01-01", "1976-06-30"),
            ("725640", "24018", "BETA FIELD", 41.2, -104.8, "1970-01-01", "1981-12-31"),
            ("00450", "99999", "FAR AWAY", 10.0, 10.0, "1970-01-01", "1981-12-31")]


@pytest.fixture(scope="module")
def files():
    rng = np.random.default_rng(0)
    d = tempfile.mkdtemp(prefix="stationlab-pipe-")
    lines = [HEADER]
    for usaf, wban, _, _, _, b, e in STATIONS:
        day, end = dt.date.fromisoformat(b), dt.date.fromisoformat(e)
        while day <= end:
            if not (usaf == "725640" and day.year == 1972):       # a gap year for the gap rule
                t = 50 + 20 * np.sin(day.timetuple().tm_yday / 58.0) + rng.normal(0, 3)
                p = 99.99 if rng.random() < 0.05 else max(0.0, rng.gamma(0.3, 0.2) - 0.02)
                lines.append(f"{usaf},{wban},{day.year},{day.month},{day.day},{t:.1f},24,{t - 10:.1f},24,1013.0,24,"
                             f"850.0,24,10.0,24,5.0,24,{t + 9:.1f},*,{t - 9:.1f},,{p:.2f},G,999.9,0,0,"
                             f"{10 if rng.random() < 0.001 else 0}")
            day += dt.timedelta(days=1)
    daily = os.path.join(d, "daily.csv")
    open(daily, "w").write("\n".join(lines))
    st = os.path.join(d, "stations.csv")
    open(st, "w").write("usaf,wban,name,country,state,call,lat,lon,elev,begin,end\n" + "\n".join(
        f"{u},{w}, {n} ,US,AZ,,{la},{lo},100.0,{b},{e}" for u, w, n, la, lo, b, e in STATIONS))
    cities = os.path.join(d, "cities.csv")
    open(cities, "w").write("city,state/province,country,latitude,longitude\nTucson,Arizona,USA,32.22,-110.97\n"
                            "Cheyenne,Wyoming,USA,41.14,-104.82\n")
    groups = os.path.join(d, "groups.csv")
    open(groups, "w").write("pair_id,usaf,wban,name,ordinal\n0,722745,99999,ALPHA OLD,0\n0,722740,23160,ALPHA AP,1\n")
    return {"daily": daily, "stations": st, "cities": cities, "groups": groups}


def test_station_pipelines(spark, files):
    daily = L.get_daily(spark, files["daily"])
    stations = R.read_stations(spark, files["stations"])
    cities = R.read_cities(spark, files["cities"])
    meta = L.station_metadata(stations, cities)
    near = {r.usaf: r.nearest_city for r in meta.collect()}
    assert near["722740"] == "Tucson" and near["725640"] == "Cheyenne"
    assert [r.name for r in stations.collect()][0] == "ALPHA AP"      # trimmed
    cand = L.candidate_stations(stations, cities, max_km=50, min_years=10)
    assert {r.usaf for r in cand.collect()} == {"722740", "725640"}

    short = L.shortlist(daily, meta)
    assert short.count() == 4
    dropped = spark.createDataFrame([("00450", "99999")], "usaf string, wban string")
    data = L.make_dataset(daily, short.select("usaf", "wban"), dropped=dropped)
    # the two-pass plan equals the rule-by-rule chain
    from stationlab.operators import cleaning as CL
    step = L.clean_precip(CL.drop_keys(L.get_subset(daily, short.select("usaf", "wban")), dropped, ["usaf", "wban"]))
    step = CL.remove_before_if_gap(step, ["usaf", "wban"], "timestamp", "1973-01-01", 1970, 1977)
    skey = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted(map(tuple, step.collect()), key=skey) == sorted(map(tuple, data.select(step.columns).collect()), key=skey)
    kept = data.groupBy("usaf").count().collect()
    assert {r.usaf for r in kept} == {"722740", "722745", "725640"}
    # the gap station loses its rows before 1973
    assert data.where("usaf = '725640' and timestamp < date'1973-01-01'").count() == 0
    assert data.where("usaf = '722740' and timestamp < date'1973-01-01'").count() > 0
    assert data.where("precipitation_total_inches > 99").count() == 0

    annual = L.annual_summary(data, meta)
    assert annual.where("usaf = '725640' and period = date'1972-01-01'").count() == 0  # dropped span
    trends = L.city_trends(annual)
    assert {r.nearest_city for r in trends["trend"].collect()} == {"Tucson", "Cheyenne"}

    rep = L.quality_report(daily, stations)
    for name, df in rep.items():
        assert df.count() >= 0, name
    assert rep["duplicates"].first().duplicate_rows == 0
    assert {"coverage_shares", "coverage_hist", "filtered_shares", "filtered_hist", "agreement_shares", "duration_diff_hist",
            "indicator_counts", "temp_f_mean_hist", "precip_log_hist"} <= set(rep)
    assert sum(r["count"] for r in rep["coverage_hist"].collect()) == 4
    assert rep["agreement_shares"].agg({"n_stations": "sum"}).first()[0] == 4

    groups = R.read_splice_groups(spark, files["groups"])
    sr = L.splice_report(daily, groups, window_years=3, n_samples=100, seed=1)
    assert sr.count() == 4 * 2       # 4 measures x (mean, std) for the one pair
    wide = L.clean_annual_precip(data, meta)
    assert "year" in wide.columns
    assert L.extreme_review(data, ratio=5.0, min_value=0.5).count() >= 0
