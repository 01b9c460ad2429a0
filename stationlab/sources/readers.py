"""Sources and sinks (S1-S10).  All readers use fixed schemas, matched to each file's header by name: ids
stay text so zero padding survives, and no schema is ever inferred.  A missing path raises
AnalysisException (PATH_NOT_FOUND).  Yearly tables are in :mod:`.yearly`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from .headers import read_by_header, read_numbered


def read_daily(spark: SparkSession, path: str | Sequence[str], on_bad: str = "raise") -> DataFrame:
    """Raw daily CSV exports -> typed, readable panel with a ``timestamp`` date column."""
    raw = read_by_header(spark, path, S.DAILY_RAW, on_bad=on_bad)
    cols = [F.col(src).alias(dst) for src, dst in S.DAILY_RENAMES.items()]
    return raw.select(
        F.col("stn").alias("usaf"), F.col("wban"),
        F.make_date("year", "mo", "da").alias(S.DATE),
        *[c for c in cols[2:]],
    )


def read_daily_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The yearly tables read as one.  Written with ``partitionBy('year')`` the scan prunes
    by the partition column; compare ``year`` itself, since ``year(timestamp) > x`` is not pushed."""
    return spark.read.option("basePath", path).parquet(path)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station list, ids as text, two dates, readable names, trimmed station name."""
    df = read_by_header(spark, path, S.STATIONS_RAW)
    return df.withColumnsRenamed(S.STATION_RENAMES).withColumn("name", F.trim("name"))


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """S3: city list.  The header ``state/province`` is the column ``state_province``."""
    return read_by_header(spark, path, S.CITIES)


def read_exclusion_points(spark: SparkSession, path: str) -> DataFrame:
    """(key, date) points; the file repeats some rows, so they are de-duplicated here."""
    return read_by_header(spark, path, S.EXCLUSION_POINTS).dropDuplicates()


def read_exclusion_years(spark: SparkSession, path: str) -> DataFrame:
    """(key, year) slices, one closed year per row."""
    return read_by_header(spark, path, S.EXCLUSION_YEARS).dropDuplicates()


def read_splice_groups(spark: SparkSession, path: str) -> DataFrame:
    """Groups of stations to splice.  Members are ordered by ``ordinal``: the file's own column, or
    where it has none the row's place in the file."""
    return read_numbered(spark, path, S.SPLICE_GROUPS, "ordinal")


def read_selected_stations(spark: SparkSession, path: str) -> DataFrame:
    """The shortlisted stations with extents and nearest city."""
    return read_by_header(spark, path, S.SELECTED_STATIONS)


def key_table(spark: SparkSession, keys: Sequence[Sequence[str]], names: Sequence[str] = S.KEY) -> DataFrame:
    """An inline list of keys as a table.  Its size is the list's, so it is broadcast."""
    schema = ", ".join(f"{n} string" for n in names)
    return F.broadcast(spark.createDataFrame([tuple(k) for k in keys], schema=schema))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, keys included."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
                  files_per_partition: int | None = None, sort_by: Sequence[str] = ()) -> None:
    """Main sink: parquet, optionally partitioned (e.g. by year for pruning on later scans).

    A partitioned write left to the input partitioning makes every input task write one file
    into every partition value it holds (millions of small files on a large input).  So by
    default the rows are shuffled with Spark's ``rebalance`` hint on the partition columns: AQE
    splits a large partition value (one year of a 100 TB table) over many tasks and merges small
    ones, so files come out near the advisory partition size.  ``files_per_partition`` asks for
    a fixed count instead: the shuffle is on (partition columns, hash of the whole row mod the
    count) -- a hash of the station key would put a hot station's year into one file; a hash of
    row values gives a retried task the same rows.  ``sort_by`` (e.g. key and date) orders the
    rows within each file, so the parquet row-group statistics prune scans on those columns."""
    if partition_by and files_per_partition:
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(int(files_per_partition)))
        df = df.repartition(*[F.col(c) for c in partition_by], spread)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def with_year_partition(df: DataFrame, date_col: str = S.DATE) -> DataFrame:
    """Add the ``year`` partition column used by :func:`write_parquet` for the daily panel."""
    return df.withColumn("year", F.year(date_col))
