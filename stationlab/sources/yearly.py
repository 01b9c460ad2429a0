"""Yearly tables with drifting schemas (S8, S10): one folder per year and run, and a manifest.

A write puts each year it holds into a folder of its own run and, only after all of it is there, adds one
row per year to the manifest: run, row count, schema.  Readers follow the manifest's latest run of
each year, so a year is replaced as a whole, other years are not touched, and what a failed write left
behind is never read.  Years may have been written with different columns and types; the scan brings
them to one schema.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "year int, run string, version long, rows long, columns string"
_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_REAL = [T.FloatType(), T.DoubleType()]


def _manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}/_manifest"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every year ever published: year, run, version, rows, columns (the run's schema as JSON)."""
    try:
        return spark.read.schema(MANIFEST).parquet(_manifest_path(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's latest row of each year (one row per year of the table)."""
    latest = F.max_by(F.struct("run", "version", "rows", "columns"), F.struct("version", "run")).alias("m")
    return manifest(spark, path).groupBy("year").agg(latest).select("year", "m.*")


def write_years(df: DataFrame, path: str, year_col: str = "year") -> DataFrame:
    """Replaces the years that ``df`` holds; returns their manifest rows.  Rows with a NULL year are refused.

    The data job writes into new folders only; the manifest is one small file, written last and whole.  A
    write that fails before that leaves the table as it was, and a rerun simply publishes a newer run."""
    spark = df.sparkSession
    if year_col not in df.columns:
        raise ValueError(f"no column {year_col}")
    run = uuid.uuid4().hex
    year = F.when(F.col(year_col).isNull(), F.raise_error(F.lit(f"{year_col} is NULL")).cast("int")).otherwise(F.col(year_col).cast("int"))
    columns = T.StructType([f for f in df.schema.fields if f.name != year_col])
    df.withColumn("year", year).withColumn("run", F.lit(run)).select(*[F.col(f"`{c}`") for c in columns.names], "year", "run") \
        .hint("rebalance", "year").write.mode("append").partitionBy("year", "run").parquet(path)
    before = manifest(spark, path).agg(F.max("version")).first()[0] or 0
    try:
        done = spark.read.option("basePath", path).schema("year int, run string").parquet(f"{path.rstrip('/')}/year=*/run={run}")
        done = done.groupBy("year").agg(F.count(F.lit(1)).alias("rows"))
    except AnalysisException as e:  # no rows, so no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    entry = done.select("year", F.lit(run).alias("run"), F.lit(before + 1).cast("long").alias("version"), F.col("rows").cast("long").alias("rows"),
                        F.lit(columns.json()).alias("columns"))
    entry.coalesce(1).write.mode("append").parquet(_manifest_path(path))
    return manifest(spark, path).where(F.col("run") == run)


def widest(name: str, types: list[T.DataType]) -> T.DataType:
    """One type for a column that years hold in several: whole numbers widen, whole and real numbers become
    double, dates and timestamps become timestamp; anything else must agree."""
    kinds = list(dict.fromkeys(types))
    if len(kinds) == 1:
        return kinds[0]
    if all(k in _WHOLE for k in kinds):
        return max(kinds, key=_WHOLE.index)
    if all(k in _WHOLE + _REAL for k in kinds):
        return T.DoubleType()
    if all(isinstance(k, (T.DateType, T.TimestampType)) for k in kinds):
        return T.TimestampType()
    raise ValueError(f"column {name} is {' and '.join(k.simpleString() for k in kinds)} in different years")


def scan_years(spark: SparkSession, path: str, years: Iterable[int] | None = None) -> DataFrame:
    """The current rows of all years (or of the listed ones) in one schema, with ``year``.

    Columns are the union over the years, NULL where a year lacks one.  Years of one schema are one scan
    whose partition column is ``year``: a filter on it prunes folders.  Raises FileNotFoundError if
    nothing is published."""
    rows = current(spark, path)
    if years is not None:
        rows = rows.where(F.col("year").isin([int(y) for y in years]))
    published = rows.orderBy("year").collect()  # one row per year
    if not published:
        raise FileNotFoundError(f"no published year at {path}")
    schemas = {r["columns"]: T.StructType.fromJson(json.loads(r["columns"])) for r in published}
    names = list(dict.fromkeys(f.name for s in schemas.values() for f in s.fields))
    types = {n: widest(n, [s[n].dataType for s in schemas.values() if n in s.names]) for n in names}
    parts = []
    for text, schema in schemas.items():
        folders = [f"{path.rstrip('/')}/year={r['year']}/run={r['run']}" for r in published if r["columns"] == text]
        full = T.StructType([*schema.fields, T.StructField("year", T.IntegerType()), T.StructField("run", T.StringType())])
        x = spark.read.option("basePath", path).schema(full).parquet(*folders)
        parts.append(x.select(*[(F.col(f"`{n}`").cast(types[n]) if n in schema.names else F.lit(None).cast(types[n])).alias(n) for n in names], "year"))
    return reduce(DataFrame.unionByName, parts)


def check_years(spark: SparkSession, path: str) -> DataFrame:
    """year, rows (published), found: one row per year whose folder does not hold the published number of rows."""
    found = scan_years(spark, path).groupBy("year").agg(F.count(F.lit(1)).alias("found"))
    return current(spark, path).select("year", "rows").join(found, "year", "left").withColumn("found", F.coalesce("found", F.lit(0))) \
        .where("rows <> found")
