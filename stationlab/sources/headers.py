"""CSV sources read by their headers, with numbered lines and a quarantine for bad rows.

Files of one source may have different headers: columns in another order, further columns, or a few
exports mixed.  Each file's own header says where its columns are; files with the same header are read
together, columns are taken by name and cast, and what is missing is reported with the file.  Rows that
do not fit (a wrong number of fields, or a value that is not of its column's type) either stop the job
or go to a quarantine table with file and line number.

Line numbers are made in two levels: a split of a file numbers its own lines, and the lines of the splits
before it are added.  They do not depend on the size of the splits or on the order of tasks.
A record is one line; quoted line breaks are not supported.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null
from ..plans.physical import attach, materialize

BAD = "_bad_record"


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def column_name(text: str) -> str:
    """A header entry as a column name: lower case, runs of other characters than letters and digits as one
    underscore (``state/province`` is ``state_province``)."""
    return re.sub(r"[^0-9a-z]+", "_", text.strip().lower()).strip("_")


def _split_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, block (start of the split), id (grows along a split's lines), text."""
    lines = spark.read.text(_paths(path))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Every line of the files: file, line (from 1, in file order), text.

    The lines are written once, so that both levels see the same splits; per split there is one row of
    counts, and the only window runs over the splits of a file."""
    lines = materialize(_split_lines(spark, path))
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0))).drop("lines")
    return attach(lines, splits, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "text")


def _first_of_files():
    """Keeps each file's first line of a task.  Every line would go into an aggregate of texts, which Spark sorts by
    file in memory; here the lines pass by, and one per file stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            # a task reads its files one after the other, so few names stand in a batch
            names = batch.column("file").dictionary_encode()
            new = [i for i, name in enumerate(names.dictionary.to_pylist()) if name not in seen]
            seen.update(names.dictionary.to_pylist())
            if new:
                yield batch.take(pa.array([pc.index(names.indices, i).as_py() for i in new], pa.int64()))

    return run


def headers(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The headers that occur, as column names in file order, with the files that have them.  One name per
    file comes to the driver, which has listed the files anyway."""
    lines = _split_lines(spark, path).where("block = 0").select("file", "id", "text")
    first = lines.mapInArrow(_first_of_files(), lines.schema).groupBy("file").agg(F.min_by("text", "id").alias("header"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").collect():
        names = tuple(column_name(c) for c in next(csv.reader([row["header"].lstrip("﻿")]), []))
        found.setdefault(names, []).append(row["file"])
    return found


def _check(names: tuple[str, ...], files: list[str], schema: T.StructType, optional: Iterable[str]) -> None:
    missing = [f.name for f in schema.fields if f.name not in names and f.name not in optional]
    twice = sorted({n for n in names if n and names.count(n) > 1 and n in schema.names})
    if missing or twice:
        what = " and ".join([f"no column {', '.join(missing)}"] * bool(missing) + [f"two columns {', '.join(twice)}"] * bool(twice))
        raise ValueError(f"{files[0]}{f' and {len(files) - 1} more files' if len(files) > 1 else ''}: {what}")


def _text_schema(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(BAD, T.StringType())])


def _typed(names: tuple[str, ...], schema: T.StructType, date_format: str, at=F.col) -> tuple[list[Column], Column]:
    """The schema's columns from the text columns ``at("c<i>")``, and the names of the columns that do not fit."""
    out, wrong = [], [F.when(at(BAD).isNotNull(), F.lit("number of fields"))]
    for f in schema.fields:
        if f.name not in names:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        raw = at(f"c{names.index(f.name)}")
        if isinstance(f.dataType, T.StringType):
            out.append(raw.alias(f.name))
            continue
        given = F.nullif(F.trim(raw), F.lit(""))
        value = F.try_to_timestamp(given, F.lit(date_format)).cast("date") if isinstance(f.dataType, T.DateType) else given.try_cast(f.dataType)
        wrong.append(F.when(given.isNotNull() & value.isNull(), F.lit(f.name)))
        # the text NaN is a missing value, as everywhere in the library
        out.append((nan_to_null(value) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else value).alias(f.name))
    return out, F.concat_ws(", ", *wrong)


def read_by_header(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, optional: Iterable[str] = (),
                   on_bad: str = "raise", date_format: str = "yyyy-MM-dd") -> DataFrame:
    """The schema's columns of all files, taken by name and cast.

    Columns of ``optional`` may be missing (NULL); any other missing column is a ValueError that names it
    and the file.  Further columns are ignored.  Empty fields are NULL.  A bad row stops the job with its
    file and the columns at fault (``on_bad='raise'``) or is left out (``'drop'``; :func:`bad_rows` has it)."""
    if on_bad not in ("raise", "drop"):
        raise ValueError("on_bad is raise or drop")
    optional, parts = set(optional), []
    for names, files in headers(spark, path).items():
        _check(names, files, schema, optional)
        reader = spark.read.schema(_text_schema(names)).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
        raw = reader.csv(files)
        cols, wrong = _typed(names, schema, date_format)
        x = raw.select(*cols, wrong.alias("_wrong"), F.col("_metadata.file_path").alias("_file"))
        if on_bad == "raise":
            fault = F.raise_error(F.concat(F.lit("bad row in "), F.col("_file"), F.lit(": "), F.col("_wrong")))
            x = x.where(F.when(F.col("_wrong") == "", F.lit(True)).otherwise(fault.cast("boolean")))
        else:
            x = x.where("_wrong = ''")
        parts.append(x.drop("_wrong", "_file"))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def _parsed_lines(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, optional: Iterable[str], date_format: str) -> DataFrame:
    """file, line, text, the schema's columns and _wrong, one row per data line."""
    lines = numbered_lines(spark, path).where((F.col("line") > 1) & (F.trim("text") != ""))
    parts = []
    for names, files in headers(spark, path).items():
        _check(names, files, schema, set(optional))
        mine = F.broadcast(spark.createDataFrame([(f,) for f in files], "file string"))  # one thin row per file listed
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
        x = lines.join(mine, "file", "left_semi").withColumn("_p", F.from_csv("text", _text_schema(names).simpleString()[7:-1].replace(":", " "), options))
        cols, wrong = _typed(names, schema, date_format, lambda c: F.col("_p")[c])
        parts.append(x.select(F.col("file").alias("_file"), F.col("line").alias("_line"), F.col("text").alias("_text"), *cols, wrong.alias("_wrong")))
    return reduce(DataFrame.unionByName, parts)


def bad_rows(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, optional: Iterable[str] = (),
             date_format: str = "yyyy-MM-dd") -> DataFrame:
    """The quarantine: file, line, text and reason of every row that :func:`read_by_header` does not take."""
    x = _parsed_lines(spark, path, schema, optional, date_format).where("_wrong <> ''")
    return x.select(F.col("_file").alias("file"), F.col("_line").alias("line"), F.col("_text").alias("text"), F.col("_wrong").alias("reason"))


def read_numbered(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, ordinal: str, optional: Iterable[str] = (),
                  date_format: str = "yyyy-MM-dd") -> DataFrame:
    """The schema's columns by name, with ``ordinal`` (long): the row's place in its file, from 1 at the line after
    the header.  An ``ordinal`` column in a file is used instead.  Bad rows stop the job."""
    base = T.StructType([f for f in schema.fields if f.name != ordinal] + [T.StructField(ordinal, T.LongType())])
    x = _parsed_lines(spark, path, base, {*optional, ordinal}, date_format)
    place = F.concat(F.col("_file"), F.lit(" line "), F.col("_line").cast("string"), F.lit(": "), F.col("_wrong"))
    x = x.where(F.when(F.col("_wrong") == "", F.lit(True)).otherwise(F.raise_error(place).cast("boolean")))
    number = F.coalesce(F.col(ordinal), F.col("_line") - 1)
    return x.select(*[number.alias(ordinal) if f.name == ordinal else F.col(f"`{f.name}`") for f in base.fields])


