"""CSV by header, numbered lines, quarantine, and yearly tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import types as T

from stationlab.sources import headers as H
from stationlab.sources import readers as R
from stationlab.sources import yearly as Y

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("day", T.DateType()), T.StructField("n", T.ShortType()),
                       T.StructField("v", T.DoubleType())])


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_reordered_widened_and_mixed_exports(spark, tmp_path):
    p = put(tmp_path / "x", "a.csv", "id,day,n,v", '007,2020-01-02,3,1.5', '"a,b",2020-01-03,,NaN')
    put(tmp_path / "x", "b.csv", "V,extra,N,Day, ID ", "2.5,zzz,4,2020-02-01,008")
    put(tmp_path / "x", "c.csv", "﻿id,day,n,v", "009,2020-03-01,5,")
    put(tmp_path / "x", "empty.csv", "v,n,day,id")
    d = dt.date
    assert rows(H.read_by_header(spark, p, SCHEMA)) == sorted([
        ("007", d(2020, 1, 2), 3, 1.5), ("a,b", d(2020, 1, 3), None, None), ("008", d(2020, 2, 1), 4, 2.5), ("009", d(2020, 3, 1), 5, None)], key=str)
    assert len(H.headers(spark, p)) == 3


def test_missing_and_repeated_columns_are_named(spark, tmp_path):
    p = put(tmp_path / "x", "good.csv", "id,day,n,v", "1,2020-01-01,1,1")
    put(tmp_path / "x", "short.csv", "id,day,v", "1,2020-01-01,1")
    with pytest.raises(ValueError, match=r"short\.csv: no column n"):
        H.read_by_header(spark, p, SCHEMA)
    assert H.read_by_header(spark, p, SCHEMA, optional=["n"]).count() == 2
    twice = put(tmp_path / "y", "twice.csv", "id,day,n,v,n", "1,2020-01-01,1,1,2")
    with pytest.raises(ValueError, match=r"twice\.csv: two columns n"):
        H.read_by_header(spark, twice, SCHEMA)


def test_bad_rows_are_raised_dropped_or_quarantined(spark, tmp_path):
    p = put(tmp_path / "x", "a.csv", "id,day,n,v", "1,2020-01-01,1,1", "2,2020-13-01,1,1", "3,2020-01-01,99999,x", "", "4,2020-01-01", "5,2020-01-05,2,2")
    put(tmp_path / "x", "b.csv", "v,n,day,id", "1,2,2020-01-07,6", "1,2,2020-01-08,7,8")
    with pytest.raises(Exception, match="bad row in"):
        H.read_by_header(spark, p, SCHEMA).collect()
    assert [r[0] for r in rows(H.read_by_header(spark, p, SCHEMA, on_bad="drop"))] == ["1", "5", "6"]
    bad = H.bad_rows(spark, p, SCHEMA)
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.text, r.reason) for r in bad.collect())
    assert got == [("a.csv", 3, "2,2020-13-01,1,1", "day"), ("a.csv", 4, "3,2020-01-01,99999,x", "n, v"),
                   ("a.csv", 6, "4,2020-01-01", "number of fields"), ("b.csv", 3, "1,2,2020-01-08,7,8", "number of fields")]


@pytest.mark.parametrize("split", ["128m", "4k", "997"])
def test_lines_are_numbered_alike_for_any_split(spark, tmp_path, split):
    r = random.Random(4)
    want = {}
    for name in ("one.csv", "two.csv", "three.csv"):
        lines = [f"{name} {i} " + "x" * r.randint(0, 60) if r.random() < 0.9 else "" for i in range(400)]
        put(tmp_path / "x", name, *lines)
        want[name] = lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {}
        lines = H.numbered_lines(spark, str(tmp_path / "x"))
        for x in lines.collect():
            got.setdefault(x.file.rsplit("/", 1)[1], {})[x.line] = x.text
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {n: [g[i + 1] for i in range(len(g))] for n, g in got.items()} == want


@pytest.mark.parametrize("split", ["128m", "300"])
def test_splice_groups_without_an_ordinal_keep_file_order(spark, tmp_path, split):
    members = [(i // 3, f"{(i * 7919) % 1000:06d}", "99999", f"station {i}") for i in range(200)]
    p = put(tmp_path / "g", "groups.csv", "pair_id,usaf,wban,name", *[",".join(map(str, m)) for m in members])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = R.read_splice_groups(spark, p).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = sorted(got, key=lambda x: x.ordinal)
    assert [x.ordinal for x in got] == list(range(1, 201)) and [(x.pair_id, x.usaf, x.wban, x.name) for x in got] == members
    own = put(tmp_path / "h", "groups.csv", "ordinal,pair_id,usaf,wban,name", "9,1,000001,1,b", "4,1,000002,1,a")
    assert sorted(x.ordinal for x in R.read_splice_groups(spark, own).collect()) == [4, 9]


def test_other_sources_by_name(spark, tmp_path):
    p = put(tmp_path / "y", "years.csv", "year,wban,usaf,note", "1999,1,000007,x", "1999,1,000007,y")
    assert rows(R.read_exclusion_years(spark, p)) == [("000007", "1", 1999)]
    c = put(tmp_path / "c", "cities.csv", ",city,state/province,longitude,latitude,country", "0,Reno,NV,-119.8,39.5,US")
    assert rows(R.read_cities(spark, c)) == [("Reno", "NV", "US", 39.5, -119.8)]
    s = put(tmp_path / "s", "stations.csv", "begin,end,usaf,wban,name,country,state,call,lat,lon,elev", "1950-01-01,2020-12-31,000450,7,  TOWN  ,US,NV,KX,39.1,-119.2,100.5")
    got = R.read_stations(spark, s).first()
    assert got["name"] == "TOWN" and got["usaf"] == "000450" and got["nominal_end_date"] == dt.date(2020, 12, 31) and got["elevation"] == 100.5
    none = put(tmp_path / "k", "sel.csv", ",".join(f.name for f in __import__("stationlab.schemas", fromlist=["x"]).SELECTED_STATIONS.fields))
    assert R.read_selected_stations(spark, none).count() == 0
    assert rows(R.key_table(spark, [("1", "2")])) == [("1", "2")]
    out = str(tmp_path / "out")
    R.write_csv(spark.createDataFrame([("1", "9", 2001)], "usaf string, wban string, year int"), out)
    assert rows(R.read_exclusion_years(spark, out)) == [("1", "9", 2001)]


# yearly tables -------------------------------------------------------------------------------
def test_one_year_is_replaced_and_schemas_are_brought_together(spark, tmp_path):
    p = str(tmp_path / "t")
    Y.write_years(spark.createDataFrame([(2000, "a", 1), (2001, "a", 2), (2001, "b", 3)], "year int, k string, n int"), p)
    Y.write_years(spark.createDataFrame([(2002, "c", 1 << 40, 0.5)], "year int, k string, n long, extra double"), p)
    assert rows(Y.scan_years(spark, p)) == sorted([("a", 1, None, 2000), ("a", 2, None, 2001), ("b", 3, None, 2001), ("c", 1 << 40, 0.5, 2002)], key=str)
    Y.write_years(spark.createDataFrame([(2001, "z", 9.5)], "year int, k string, n double"), p)
    got = Y.scan_years(spark, p)
    assert rows(got.select("year", "k", "n")) == [(2000, "a", 1.0), (2001, "z", 9.5), (2002, "c", float(1 << 40))]
    assert rows(Y.scan_years(spark, p, [2000]).select("k")) == [("a",)]
    assert rows(Y.current(spark, p).select("year", "rows", "version")) == [(2000, 1, 1), (2001, 1, 3), (2002, 1, 2)]
    assert Y.check_years(spark, p).count() == 0


def test_a_failed_write_leaves_no_half_year(spark, tmp_path):
    p = str(tmp_path / "t")
    Y.write_years(spark.createDataFrame([(2000, 1), (2001, 1)], "year int, n int"), p)
    # some rows reach the folder of a run that is never published
    spark.createDataFrame([(2001, 7, "lost")], "year int, n int, run string").write.mode("append").partitionBy("year", "run").parquet(p)
    assert rows(Y.scan_years(spark, p)) == [(1, 2000), (1, 2001)]
    with pytest.raises(Exception, match="NULL"):
        Y.write_years(spark.createDataFrame([(2001, 5), (None, 6)], "year int, n int"), p)
    assert rows(Y.scan_years(spark, p)) == [(1, 2000), (1, 2001)]
    Y.write_years(spark.createDataFrame([(2001, 5)], "year int, n int"), p)
    assert rows(Y.scan_years(spark, p)) == [(1, 2000), (5, 2001)]
    assert Y.write_years(spark.createDataFrame([], "year int, n int"), p).count() == 0


def test_a_year_filter_prunes_folders(spark, tmp_path):
    p = str(tmp_path / "t")
    Y.write_years(spark.range(100).selectExpr("cast(1990 + id % 10 as int) AS year", "id AS n"), p)
    plan = Y.scan_years(spark, p).where("year = 1995 and n > 50")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "GreaterThan(n,50)" in plan


def test_types_that_do_not_meet_and_nothing_published(spark, tmp_path):
    p = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        Y.scan_years(spark, p)
    Y.write_years(spark.createDataFrame([(2000, "x")], "year int, n string"), p)
    Y.write_years(spark.createDataFrame([(2001, 1)], "year int, n int"), p)
    with pytest.raises(ValueError, match="column n is string and int"):
        Y.scan_years(spark, p)
