"""Data-quality checks (Q1-Q7).  Each check is one aggregate over the rows: flags as
``bool_or`` and violation counts as conditional counts, so a check is a single pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import true_or_false
from .stats import describe, fraction, value_counts


def _k(keys) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def rule_violations(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] | None = None) -> DataFrame:
    """Q1/Q3: for each named rule (a condition that should never hold), whether any row breaks it
    and how many; a NULL comparison does not count as a violation."""
    aggs = []
    for name, cond in rules.items():
        c = true_or_false(cond)
        aggs += [F.bool_or(c).alias(f"any_{name}"), F.count_if(c).alias(f"n_{name}")]
    return df.groupBy(*_k(by)).agg(F.count(F.lit(1)).alias("rows"), *aggs)


def any_of(cols: Sequence[str]) -> Column:
    """Q2: indicator that any of the columns is set (NULL counts as not set)."""
    return F.greatest(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cols]) > 0


def indicator_profile(df: DataFrame, flag: Column, value_col: str) -> DataFrame:
    """Q2: describe a value split by an indicator, with its zero share and null share."""
    x = df.withColumn("_flag", true_or_false(flag))
    d = describe(x, [value_col], by=["_flag"])
    shares = x.groupBy("_flag").agg(fraction(F.col(value_col) == 0).alias("zero_share"),
                                    fraction(F.col(value_col).isNull()).alias("null_share"))
    return d.join(shares, "_flag").withColumnRenamed("_flag", "flag")


def resolution_profile(df: DataFrame, keys: Sequence[str], count_col: str) -> DataFrame:
    """Q4: describe the per-reading sample count per key, then how often each max / p75 / min occurs
    across keys (long form: statistic, value, n_keys)."""
    d = describe(df, [count_col], by=keys)
    long = d.select(F.col("max").alias("max"), F.col("p75").alias("p75"), F.col("min").alias("min")) \
        .unpivot([], ["max", "p75", "min"], "statistic", "value")
    return value_counts(long, ["statistic", "value"])


def filtered_coverage(df: DataFrame, keys: Sequence[str], date_col: str, value_col: str, count_col: str,
                      min_count: int) -> DataFrame:
    """Q5: values kept only where the sample count reaches ``min_count``; non-null kept values
    over the key's expected days (first..last inclusive)."""
    d = F.to_date(F.col(date_col))
    kept = F.when(true_or_false(F.col(count_col) >= F.lit(min_count)), F.col(value_col))
    agg = df.groupBy(*_k(keys)).agg(F.count(kept).alias("kept"), F.min(d).alias("_lo"), F.max(d).alias("_hi"))
    return agg.withColumn("filtered_coverage",
                          F.try_divide(F.col("kept").cast("double"), (F.datediff("_hi", "_lo") + 1).cast("double"))) \
        .drop("_lo", "_hi")


def last_year_is(df: DataFrame, keys: Sequence[str], date_col: str, year: int) -> DataFrame:
    """Q6: keys whose last row falls in ``year`` (currently operating)."""
    return df.groupBy(*_k(keys)).agg(F.max(F.to_date(F.col(date_col))).alias("last_date")) \
        .withColumn("operating", F.year("last_date") == F.lit(year))


def check_counts(df: DataFrame, expected_rows: int | None = None, distinct_cols: Sequence[str] = (),
                 expected_distinct: int | None = None) -> DataFrame:
    """Q7: a one-row check job that fails (``raise_error``) if the row count or a distinct count
    is not what is expected; returns the measured figures otherwise."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if distinct_cols:
        aggs.append(F.count_distinct(*distinct_cols).alias("distinct"))
    out = df.agg(*aggs)
    if expected_rows is not None:
        out = out.withColumn("rows", F.when(F.col("rows") == expected_rows, F.col("rows"))
                             .otherwise(F.raise_error(F.lit(f"row count differs from {expected_rows}"))))
    if expected_distinct is not None and distinct_cols:
        out = out.withColumn("distinct", F.when(F.col("distinct") == expected_distinct, F.col("distinct"))
                             .otherwise(F.raise_error(F.lit(f"distinct count differs from {expected_distinct}"))))
    return out
