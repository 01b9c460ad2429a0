import datetime as dt
import os
import tempfile

from stationlab.plans import pipelines as L
from stationlab.sources import readers as R

HEADER = ("stn,wban,year,mo,da,temp,count_temp,dewp,count_dewp,slp,count_slp,stp,count_stp,visib,count_visib,"
          "wdsp,count_wdsp,max,flag_max,min,flag_min,prcp,flag_prcp,sndp,rain_drizzle,snow_ice_pellets,hail")


def _write(text):
    d = tempfile.mkdtemp(prefix="stationlab-src-")
    p = os.path.join(d, "daily.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_read_daily_types_markers_and_recode(spark):
    body = "\n".join([
        HEADER,
        "00450,99999,1980,2,29,9999.9,0,40.1,8,1013.2,8,9999.9,0,999.9,0,5.0,8,60.0,*,9999.7,,99.99,I,999.9,10,10,10",
        "00450,99999,1980,3,1,NaN,8,41.0,8,1012.0,8,900.0,8,10.0,8,4.0,8,61.0,,40.0,*,0.10,A,0.0,0,0,0",
    ])
    df = L.get_daily(spark, _write(body))
    got = {r.timestamp: r for r in df.collect()}
    a, b = got[dt.date(1980, 2, 29)], got[dt.date(1980, 3, 1)]
    assert a.usaf == "00450" and a.wban == "99999"          # zero padding kept
    assert a.temp_f_mean is None and a.temp_f_min == 9999.7  # marker vs near miss
    assert a.precipitation_total_inches is None and a.visibility_miles_mean is None
    assert a.had_rain == 10 and a.had_hail == 0 and a.had_snow_ice == 0
    assert b.temp_f_mean is None                               # text NaN -> NULL
    assert b.precipitation_total_inches == 0.10


def test_exclusion_points_deduplicated(spark):
    p = _write('usaf,wban,timestamp\n"000417","90001","1991-05-17"\n"000417","90001","1991-05-17"\n')
    assert R.read_exclusion_points(spark, p).count() == 1


def test_missing_path_raises(spark):
    import pytest

    with pytest.raises(Exception):
        R.read_stations(spark, "/nonexistent/stations.csv").count()


def test_partitioned_write_files_per_year_and_round_trip(spark, tmp_path):
    import datetime as dt
    import os

    from stationlab.sources import readers as R

    recs = [(str(k % 5), "A", dt.date(1990 + k % 3, 1, 1) + dt.timedelta(days=k % 300), float(k)) for k in range(3000)]
    df = spark.createDataFrame(recs, "usaf string, wban string, timestamp date, v double").repartition(12)
    out = str(tmp_path / "daily")
    R.write_parquet(R.with_year_partition(df), out, ["year"], files_per_partition=2, sort_by=["usaf", "timestamp"])
    for y in (1990, 1991, 1992):
        files = [f for f in os.listdir(os.path.join(out, f"year={y}")) if f.endswith(".parquet")]
        assert 1 <= len(files) <= 2                             # not one file per input task
    back = R.read_daily_parquet(spark, out)
    assert back.count() == 3000
    assert sorted(r.v for r in back.where("year = 1991").collect()) == sorted(r[3] for r in recs if r[2].year == 1991)


def test_partitioned_write_rebalances_by_default(spark, tmp_path):
    import datetime as dt

    from stationlab.sources import readers as R

    recs = [(str(k % 5), "A", dt.date(1990 + k % 3, 1, 1) + dt.timedelta(days=k % 300), float(k)) for k in range(2000)]
    df = spark.createDataFrame(recs, "usaf string, wban string, timestamp date, v double").repartition(9)
    out = str(tmp_path / "daily")
    R.write_parquet(R.with_year_partition(df), out, ["year"])
    back = R.read_daily_parquet(spark, out)
    assert sorted(r.v for r in back.collect()) == sorted(r[3] for r in recs)
    assert {r.year for r in back.select("year").distinct().collect()} == {1990, 1991, 1992}


def test_get_spark_keeps_the_submitters_settings(spark):
    from stationlab.session import get_spark

    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        s = get_spark()                                         # reuses the running session
        assert s.conf.get("spark.sql.shuffle.partitions") == "37"
        assert s.sparkContext.getCheckpointDir()
        assert get_spark(shuffle_partitions=8).conf.get("spark.sql.shuffle.partitions") == "8"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
