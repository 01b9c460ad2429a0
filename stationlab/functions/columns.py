"""Column-level helpers.  Every function returns a ``Column`` built from built-in Spark functions,
so all of them stay inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Mean Earth radius used for great-circle distances (km), and the days in a
# Julian year used to turn day counts into years.
EARTH_RADIUS_KM = 6371.0
DAYS_PER_YEAR = 365.25


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN becomes NULL (Spark compares NaN as larger than every number; NULL is the only missing)."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def is_close(c: ColumnOrName, target: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """NumPy ``isclose`` semantics: ``|x - target| <= atol + rtol * |target|``; NULL input gives false."""
    return F.coalesce(F.abs(col(c) - F.lit(float(target))) <= F.lit(atol + rtol * abs(float(target))), F.lit(False))


def sentinel_to_null(c: ColumnOrName, sentinel: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """NULL where the value is close to the missing-value marker, else the value."""
    c = col(c)
    return F.when(~is_close(c, sentinel, rtol, atol), c)


def zero_to_null(c: ColumnOrName) -> Column:
    return F.nullif(col(c), F.lit(0))


def keep_if(cond: Column, value: ColumnOrName) -> Column:
    """Conditional null: the value where ``cond`` is true, NULL where it is false or NULL."""
    return F.when(F.coalesce(cond, F.lit(False)), col(value))


def true_or_false(cond: Column) -> Column:
    """A NULL comparison counts as false, as a pandas comparison with NaN does."""
    return F.coalesce(cond, F.lit(False))


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Division that yields NULL for a zero denominator (plain ``/`` raises under ANSI mode)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def haversine_km(lat1: ColumnOrName, lon1: ColumnOrName, lat2: ColumnOrName, lon2: ColumnOrName,
                 radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance between two points given in degrees."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dphi = p2 - p1
    dlmb = F.radians(col(lon2)) - F.radians(col(lon1))
    h = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    # clamp round-off above 1 (asin domain); a NULL coordinate must stay NULL, which rules out least()
    return F.lit(2.0 * radius_km) * F.asin(F.sqrt(F.when(h > 1.0, F.lit(1.0)).otherwise(h)))


def days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    return F.datediff(F.to_date(col(end)), F.to_date(col(start)))


def duration_years(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Span in years: whole days / 365.25."""
    return days_between(start, end).cast("double") / F.lit(DAYS_PER_YEAR)


def as_date(c: ColumnOrName) -> Column:
    return F.to_date(col(c))


def year_start(c: ColumnOrName) -> Column:
    return F.trunc(as_date(c), "YEAR")


def daily_spread(tmax: ColumnOrName, tmin: ColumnOrName) -> Column:
    return col(tmax) - col(tmin)


def below_flag(c: ColumnOrName, threshold: float = 32.0) -> Column:
    """1 where value <= threshold, 0 otherwise (a missing value counts as 0)."""
    return F.coalesce((col(c) <= F.lit(threshold)).cast("int"), F.lit(0))


def map_codes(c: ColumnOrName, mapping: Mapping[str, int]) -> Column:
    """Look a code up in a literal map; unknown or NULL codes give NULL."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), col(c))


def letter_rank(c: ColumnOrName, first: str = "A", last: str = "I") -> Column:
    """Letter codes first..last mapped to 0..n-1 by their position in the alphabet."""
    codes = [chr(i) for i in range(ord(first), ord(last) + 1)]
    return map_codes(c, {ch: i for i, ch in enumerate(codes)})


def hash_draw(n: ColumnOrName, *parts: ColumnOrName) -> Column:
    """Deterministic draw in [0, n): the first 8 hex digits of md5 over the joined parts, mod n.

    Depends only on the values of ``parts`` (ids, sample number, draw number), never on row order
    or partitioning, so a recomputed task after an executor loss draws the same indices.
    """
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, col(n).cast("bigint"))


# Fixed values of the integer mixing rounds below: the modulus 2**31 - 1 keeps every square under
# 2**63, so the arithmetic is exact (no overflow, no rounding) in Spark and in any SQL engine;
# the multiplier and the three offsets are arbitrary odd constants.
MIX_MODULUS = 2147483647
MIX_MULTIPLIER = 1000003
MIX_OFFSET = 12345
MIX_FINAL_OFFSETS = (54321, 98765)


def hash_seed(*parts: ColumnOrName) -> Column:
    """md5 of the joined parts reduced to [0, MIX_MODULUS): the starting state of
    :func:`mix_round`.  Meant for a small table (one row per group), so the string work is done
    once per group and the per-row draws below it use integer arithmetic only."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(MIX_MODULUS))


def mix_round(h: ColumnOrName, v: ColumnOrName | None = None, offset: int = MIX_OFFSET) -> Column:
    """One nonlinear round: (h^2 mod m + v * MIX_MULTIPLIER + offset) mod m (no ``v``: h^2 + offset).
    ``h`` should be a column reference: it is used twice."""
    m = F.lit(MIX_MODULUS)
    x = F.pmod(col(h) * col(h), m) + F.lit(offset)
    if v is not None:
        x = x + F.pmod(col(v).cast("bigint"), m) * F.lit(MIX_MULTIPLIER)
    return F.pmod(x, m)


def with_draw(df: DataFrame, out: str, n: ColumnOrName, state: str, *parts: str) -> DataFrame:
    """Add ``out``, a draw in [0, n), from integer state column ``state`` (see :func:`hash_seed`)
    and integer columns ``parts``: one :func:`mix_round` per part and two finishing rounds, each
    in its own projection so every square reads a column instead of repeating an expression tree.
    Like :func:`hash_draw` it depends only on values, never on row order or partitioning."""
    x = state
    for i, p in enumerate(list(parts) + [None] * len(MIX_FINAL_OFFSETS)):
        off = MIX_OFFSET if p is not None else MIX_FINAL_OFFSETS[i - len(parts)]
        df = df.withColumn(f"_mix{i}", mix_round(x, p, off))
        x = f"_mix{i}"
    return df.withColumn(out, F.pmod(F.col(x), col(n).cast("bigint"))).drop(
        *[f"_mix{i}" for i in range(len(parts) + len(MIX_FINAL_OFFSETS))])
