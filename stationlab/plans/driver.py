"""Driver queries: the library's operators applied to the driver's TPC-H-like tables.

Stand-ins for station data (all read in full, no sampling):
- supplier panel: ``lineitem`` reduced to one row per (supplier, ship day) -- a daily series per
  "station" with mean/max/min readings in integer tenths (as station records store them), a
  reading count and a sparse "precipitation" value
  (sum of non-zero discounts in whole percent, NULL on days whose discounts are all zero);
  measures are kept integer-valued so sums are exact in any order and in any engine;
- customer panel: ``orders`` per (customer, order day) -- a sparse series with gap years;
- ``events`` per (user, timestamp) -- a sub-daily series;
- ``supplier``/``customer`` with coordinates derived from their keys, ``nation`` as "cities".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import as_date


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("key"), as_date("l_shipdate").alias("day")).agg(
        F.round(F.avg("l_quantity") * 10).alias("temp_mean"),
        (F.max("l_quantity") * 10).alias("temp_max"),
        (F.min("l_quantity") * 10).alias("temp_min"),
        F.count(F.lit(1)).alias("temp_count"),
        F.sum(F.nullif(F.round(F.col("l_discount") * 100), F.lit(0.0))).alias("precip"),
    )


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("key"), as_date("o_orderdate").alias("day")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100)).alias("value"), F.count(F.lit(1)).alias("n_orders"))


def station_coords(df: DataFrame, key: str) -> DataFrame:
    """Deterministic coordinates from an integer key: lat in [30, 49.9], lon in [-125, -105.1]."""
    return df.withColumns({
        "latitude": F.lit(30.0) + F.pmod(F.col(key) * 7, F.lit(200)).cast("double") / 10.0,
        "longitude": F.lit(-125.0) + F.pmod(F.col(key) * 13, F.lit(200)).cast("double") / 10.0,
    })


def city_coords(nation: DataFrame) -> DataFrame:
    """Nations as cities: lat in [30, 49.2], lon in [-125, -105.8]."""
    return nation.select(
        F.col("n_name").alias("city"),
        (F.lit(30.0) + F.pmod(F.col("n_nationkey") * 17, F.lit(193)).cast("double") / 10.0).alias("latitude"),
        (F.lit(-125.0) + F.pmod(F.col("n_nationkey") * 29, F.lit(193)).cast("double") / 10.0).alias("longitude"),
    )
