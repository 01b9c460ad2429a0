"""Correlation matrix of many groups in tiles.

Groups are numbered into blocks of at most ``tile``, periods into blocks of at most ``chunk``.  A task gets one tile:
the values of two blocks of groups over one block of periods, at most 2 x tile x chunk numbers whatever
the table's size, and returns the sufficient sums of each pair by matrix products.  The sums of a pair
over all blocks of periods are added up, so neither a period nor a group is a key that gathers rows.
The matrix itself has groups^2 entries; that is the result asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.physical import attach, materialize

TILE = 64
CHUNK = 512
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def numbered(df: DataFrame, col: str, size: int, out: str) -> DataFrame:
    """The distinct values of ``col`` with their block ``out`` and place ``{out}_at`` in it: at most ``size`` to a block,
    blocks numbered from 0 (some may be empty).  Two levels: values are dealt into about n / size buckets
    by their hash, numbered inside a bucket, and a bucket is cut after each ``size`` values."""
    values = materialize(df.select(col).distinct())
    buckets = max(-(-values.count() // size), 1)
    x = values.withColumn("_bucket", F.pmod(F.xxhash64(col), F.lit(buckets)))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(col)) - 1
    x = x.withColumn("_rank", rank)
    block = F.col("_bucket") + F.floor(F.col("_rank") / size) * buckets
    return x.select(col, block.cast("int").alias(out), F.pmod(F.col("_rank"), F.lit(size)).cast("int").alias(f"{out}_at"))


def _tile_sums(table: pa.Table) -> pa.Table:
    """The sums of each pair of groups of one tile that has a common period in this block of periods."""
    lo, hi, side, at, when, value = (table.column(c).to_numpy() for c in ("lo", "hi", "side", "at", "when", "value"))
    wide, long = int(at.max()) + 1, int(when.max()) + 1
    x = np.zeros((2, long, wide))
    there = np.zeros((2, long, wide))
    x[side, when, at] = value
    there[side, when, at] = 1.0
    if lo[0] == hi[0]:
        x[1], there[1] = x[0], there[0]
    (a, b), (m, k) = x, there
    sums = [m.T @ k, a.T @ k, m.T @ b, (a * a).T @ k, m.T @ (b * b), a.T @ b]
    i, j = np.nonzero(sums[0])
    return pa.Table.from_arrays(
        [pa.array(np.full(len(i), v, dtype=np.int32)) for v in (lo[0], hi[0])] + [pa.array(v.astype(np.int32)) for v in (i, j)]
        + [pa.array(s[i, j]) for s in sums], ["lo", "hi", "i", "j", *_SUMS])


def corr_matrix(df: DataFrame, group: str, period_col: str, value_col: str, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """Pearson correlation of every ordered pair of groups over their common periods, pairwise
    complete: group_a, group_b, corr, n_common; pairs without a common period are left out.

    Rows are first reduced to one mean per (group, period); values are taken relative to their group's
    mean, so the sums do not cancel.  ``corr`` is NULL for a single common period and where a group is
    constant over the common ones.  NULL groups and periods and NULL values do not take part."""
    x = df.where(F.col(group).isNotNull() & F.col(period_col).isNotNull() & F.col(value_col).isNotNull()) \
        .groupBy(F.col(group).alias("_g"), F.col(period_col).alias("_p")).agg(F.avg(F.col(value_col).cast("double")).alias("_v"))
    x = materialize(x)
    groups = materialize(numbered(x, "_g", tile, "_block").join(x.groupBy("_g").agg(F.avg("_v").alias("_mean")), "_g"))
    last = groups.agg(F.max("_block")).first()[0]
    if last is None:
        return x.select(F.col("_g").alias("group_a"), F.col("_g").alias("group_b"), F.lit(None).cast("double").alias("corr"),
                        F.lit(0).cast("long").alias("n_common"))
    rows = attach(attach(x, groups, "_g"), numbered(x, "_p", chunk, "_when"), "_p")
    other = F.explode(F.sequence(F.lit(0), F.lit(last)))
    rows = rows.select("_block", "_block_at", "_when", "_when_at", (F.col("_v") - F.col("_mean")).alias("value"), other.alias("_other"))
    tiles = rows.select(F.least("_block", "_other").alias("lo"), F.greatest("_block", "_other").alias("hi"), F.col("_when").alias("part"),
                        (F.col("_block") > F.col("_other")).cast("int").alias("side"), F.col("_block_at").alias("at"),
                        F.col("_when_at").alias("when"), "value")
    sums = tiles.groupBy("lo", "hi", "part").applyInArrow(_tile_sums, "lo int, hi int, i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    total = sums.groupBy("lo", "hi", "i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    # what is left of a constant is rounding
    moves = (F.col("n") > 1) & (vx > F.col("sxx") * 1e-12) & (vy > F.col("syy") * 1e-12)
    corr = F.when(moves, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    # rounding must not leave [-1, 1]; a NULL stays NULL
    bounded = F.when(corr > 1.0, F.lit(1.0)).when(corr < -1.0, F.lit(-1.0)).otherwise(corr)
    total = total.select("lo", "hi", "i", "j", bounded.alias("corr"), F.col("n").cast("long").alias("n_common"))
    # pairs of different blocks stand for both orders
    one = F.struct(F.col("lo").alias("a"), F.col("i").alias("ai"), F.col("hi").alias("b"), F.col("j").alias("bi"))
    two = F.struct(F.col("hi").alias("a"), F.col("j").alias("ai"), F.col("lo").alias("b"), F.col("i").alias("bi"))
    both = total.select(F.inline(F.when(F.col("lo") == F.col("hi"), F.array(one)).otherwise(F.array(one, two))), "corr", "n_common")
    name = lambda out, block, at: groups.select(F.col("_g").alias(out), F.col("_block").alias(block), F.col("_block_at").alias(at))
    both = attach(attach(both, name("group_a", "a", "ai"), ["a", "ai"]), name("group_b", "b", "bi"), ["b", "bi"])
    return both.select("group_a", "group_b", "corr", "n_common")

