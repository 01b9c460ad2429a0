"""Output normalisation for comparison with SQL engines: whole numbers as BIGINT, measures as
DOUBLE rounded to 4 decimals, dates as ISO text.  The SQL oracles apply the same casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(c: Column, digits: int) -> Column:
    """``F.round`` of a double (half up, of its shortest decimal form), which writes and reads that form as text.  Only a
    value within 0.001 of a half needs that (scaled, below 2^33, so that it is off by 2^-19 at most); the others go to
    the nearest whole number, and its quotient by a power of ten is the double nearest to the decimal.  0.0 is added
    as a decimal has no -0.0."""
    scale = F.lit(10.0 ** digits)
    scaled = c * scale
    whole = F.rint(scaled)
    return F.when((F.abs(scaled) < 2.0 ** 33) & (F.abs(scaled - whole) < 0.499), whole / scale + F.lit(0.0)).otherwise(F.round(c, digits))


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = rounded(c.cast("double"), digits)
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)
