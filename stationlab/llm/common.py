"""Helpers shared by the training-data operators: tables, shared scratch tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# white space as the contracts define it: blank and the control characters 9 to 13
WORD = r"[^\x20\x09-\x0D]+"
# tables of at most this many thin rows (keys and counters, under 64 bytes each) are broadcast
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors (once per context), for functions that run in Python there."""
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(package):  # imported from an archive that the submitter has sent already
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._llm_shipped = True


_CACHES: dict[str, Callable[[], None]] = {}


def sole(name: str, drop: Callable[[], None] = lambda: None) -> None:
    """Says that this Python worker now works for ``name``, whose caches, if any, ``drop`` empties.  Workers serve one stage
    after another; the caches of those before would stay beside the new ones."""
    for other in [k for k in _CACHES if k != name]:
        _CACHES.pop(other)()
    _CACHES[name] = drop


def give_back() -> None:
    """Hands memory that this process has freed back to the system.  The C library keeps what lies below a block in use:
    in a driver most of what a fit on collected examples took, beside everything that later stages need."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not this C library
        pass


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again: cuts the lineage,
    is computed once however often it is read, and outlives any executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    give_back()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of thin rows, hinted for a broadcast only after its rows have been counted."""
    return F.broadcast(df) if df.count() <= max_rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.  Pure ASCII texts take the byte-wise built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, UPPER.lower()))


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, modulo 5, is 0 (a null id is not held out)."""
    crc = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    return F.coalesce(crc % 5 == 0, F.lit(False))


def own_columns(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns under fixed names, so that no other column of the table can clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in cols.items()])


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart (64 bits; null is the empty text)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that columns computed beside it can have any name."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from the struct ``row``."""
    return df.select(*[F.col(f"row.`{c}`") for c in like.columns])
