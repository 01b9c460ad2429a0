"""Joins along time: as-of lookup of many targets per key (J14) and the interval join.

Neither keeps a key together.  The as-of lookup merges both sides on the time line and carries the last
and next row over chunk borders (:mod:`.carry`); the interval join meets on (key, time bucket).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.physical import materialize
from .carry import MAX, MIN, carried

DAY_MICROS = 86_400_000_000
METHODS = ("bfill", "ffill", "nearest")
# an interval join uses every so many powers of two as bucket width: points are repeated once per width used,
# and a bucket is at most 2^WIDTH_STEP times as long as its intervals
WIDTH_STEP = 4
# rows of both sides of an as-of lookup that one task sorts
ROWS = 1_000_000


def _k(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _and(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _clock(df: DataFrame, col: str, grain: str) -> Column:
    """The time as a whole number: days, or microseconds."""
    if grain == "day":
        return F.unix_date(F.to_date(F.col(col))).cast("long")
    return F.unix_micros(F.col(col).cast("timestamp"))


def _time(number: Column, grain: str) -> Column:
    return F.date_from_unix_date(number.cast("int")) if grain == "day" else F.timestamp_micros(number)


def _tasks(spark: SparkSession, n: int) -> int | None:
    """Tasks for ``n`` rows; None while Spark's own number keeps them small."""
    if n <= ROWS * spark.sparkContext.defaultParallelism:
        return None
    return max(n // ROWS + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def asof_lookup(rows: DataFrame, targets: DataFrame, keys: Sequence[str] | str, time_col: str, target_col: str,
                methods: Mapping[str, str], values: Sequence[str] = (), grain: str = "day",
                chunk_days: int | None = None, n_rows: int | None = None) -> DataFrame:
    """J14 for any number of targets per key: every row of ``targets`` with, per entry of ``methods``
    ({output column: 'bfill' | 'ffill' | 'nearest'}), the first time >= target, the last time <= target,
    or the nearest one (ties to the earlier) among ``rows`` of the same key.  With ``values``, that
    row's values follow as ``{output}_{value}`` (of rows at one time: those of the smallest value struct).

    Both sides are reduced to one row per (key, time) and merged; the last and next row come from
    windows per (key, time chunk), carried over chunk borders by a window over one row per chunk, so
    rows x targets are never formed and no key sits in one task: a task sees at most ``chunk_days``
    days of a key.  Many rows are dealt to as many tasks as keep each at about ``ROWS`` of them, since these rows
    shrink to a few bytes when shuffled but are sorted in full; they are counted first unless ``n_rows`` says about
    how many both sides have (it changes no result).  ``grain`` is 'day' (dates; times are cut to days) or 'micros' (timestamps, chunks
    of one day unless given).  Answers, one per (key, time), join back onto the targets.

    No match, a NULL key or a NULL time gives NULL; repeated targets are each answered."""
    wrong = sorted(set(methods.values()) - set(METHODS))
    if wrong or grain not in ("day", "micros"):
        raise ValueError(f"methods are {', '.join(METHODS)}, grain is day or micros")
    k = _k(keys)
    chunk = (chunk_days or 366) if grain == "day" else (chunk_days or 1) * DAY_MICROS
    inner = [f"_k{i}" for i in range(len(k))]
    own = [F.col(f"`{c}`").alias(i) for c, i in zip(k, inner)]
    # per (key, time): is there a row, is there a target, the row's values
    hit = F.struct("_t", *[F.col(f"`{v}`").alias(f"_v{i}") for i, v in enumerate(values)]) if values else F.col("_t")
    left = rows.withColumn("_t", _clock(rows, time_col, grain)).select(*own, "_t", hit.alias("_at"), F.lit(False).alias("_ask"))
    at_type = left.schema["_at"].dataType
    right = targets.select(*own, _clock(targets, target_col, grain).alias("_t"), F.lit(None).cast(at_type).alias("_at"), F.lit(True).alias("_ask"))
    known = _and([F.col(c).isNotNull() for c in [*inner, "_t"]])
    both, tasks = left.unionByName(right).where(known), _tasks(rows.sparkSession, rows.count() + targets.count() if n_rows is None else n_rows)
    if tasks:
        both = both.repartition(tasks, *inner, "_t")
    # thin (one row per key and time), read by both levels: written once
    line = materialize(both.groupBy(*inner, "_t").agg(F.min("_at").alias("_at"), F.max("_ask").alias("_ask")))
    line = carried(line, inner, "_t", chunk, up={"_last": (MAX, F.col("_at"))}, down={"_next": (MIN, F.col("_at"))}, tasks=tasks)
    answers = line.where("_ask").select(*[F.col(c).alias(f"_a{c}") for c in [*inner, "_t"]], "_last", "_next")
    asked = targets.withColumns({f"_q{i}": F.col(f"`{c}`") for i, c in zip(inner, k)} | {"_q_t": _clock(targets, target_col, grain)})
    if tasks:
        asked = asked.repartition(tasks, *[f"_q{c}" for c in [*inner, "_t"]])
    joined = asked.join(answers, _and([F.col(f"_q{c}") == F.col(f"_a{c}") for c in [*inner, "_t"]]), "left")
    clock = (lambda c: F.col(c)["_t"]) if values else F.col
    later = F.col("_last").isNull() | (clock("_next") - F.col("_q_t") < F.col("_q_t") - clock("_last"))
    pick = {"bfill": F.col("_next"), "ffill": F.col("_last"),
            "nearest": F.when(F.col("_next").isNotNull() & later, F.col("_next")).otherwise(F.col("_last"))}
    out = []
    for name, method in methods.items():
        found = pick[method]
        out.append(_time(found["_t"] if values else found, grain).alias(name))
        out += [found[f"_v{i}"].alias(f"{name}_{v}") for i, v in enumerate(values)]
    return joined.select(*[F.col(f"`{c}`") for c in targets.columns], *out)


def interval_join(intervals: DataFrame, points: DataFrame, keys: Sequence[str] | str, low: str, high: str, at: str,
                  grain: str = "day", base: int | None = None, one_width: bool = False) -> DataFrame:
    """J10 in general: every (point, interval) of one key with low <= at <= high, as the point's columns
    and the interval's other columns.

    An equi-join on (key, width, bucket).  An interval belongs to the smallest width in use that is
    not shorter than itself, so it touches at most two buckets of that width, however long it is; a
    point lies in exactly one bucket of each width, so a pair meets once and nothing has to be
    de-duplicated.  A hot key is spread over its buckets.  Widths in use are base x 2^w for every
    ``WIDTH_STEP``-th w and for the largest w that an interval needs (found by one pass over the
    intervals).  Points are repeated once per width in use that has an interval (17 at most), as their own
    columns and the bucket; with ``one_width`` all intervals are known to be at most ``base`` long and
    points are not repeated.

    NULL keys, bounds or times match nothing; intervals with low > high hold no point; repeated rows on
    either side each match."""
    k = _k(keys)
    extra = [c for c in intervals.columns if c not in k]
    clash = sorted(set(extra) & set(points.columns))
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(clash)}")
    base = base or (1 if grain == "day" else DAY_MICROS)
    inner = [f"_k{i}" for i in range(len(k))]
    iv = intervals.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(k, inner)], *[F.col(f"`{c}`") for c in extra],
                          _clock(intervals, low, grain).alias("_lo"), _clock(intervals, high, grain).alias("_hi")) \
        .where(_and([F.col(c).isNotNull() for c in inner]) & (F.col("_lo") <= F.col("_hi")))
    if one_width:
        widths = [0]
        iv = iv.withColumn("_width", F.lit(0))
    else:
        length = (F.col("_hi") - F.col("_lo") + 1) / F.lit(base)
        iv = iv.withColumn("_width", F.greatest(F.ceil(F.log2(length)).cast("int"), F.lit(0)))
        # log2 is rounded: a length just above a power of two may need one step more
        iv = iv.withColumn("_width", F.col("_width") + (F.pow(F.lit(2.0), "_width") < length).cast("int"))
        needed = [r[0] for r in iv.select("_width").distinct().collect()]
        used = lambda w: min(-(-max(w, 1) // WIDTH_STEP) * WIDTH_STEP, max(needed))
        widths = sorted({used(w) for w in needed})
        step = F.ceil(F.greatest("_width", F.lit(1)) / F.lit(WIDTH_STEP)).cast("int") * F.lit(WIDTH_STEP)
        iv = iv.withColumn("_width", F.least(step, F.lit(max(needed, default=0))))
    span = F.lit(base) * F.pow(F.lit(2.0), "_width").cast("long")
    first, last = F.floor(F.col("_lo") / span).cast("long"), F.floor(F.col("_hi") / span).cast("long")
    iv = iv.withColumn("_bucket", F.explode(F.array_distinct(F.array(first, last))))
    here = _clock(points, at, grain)
    places = [F.struct(F.lit(w).alias("_width"), F.floor(here / F.lit(base << w)).cast("long").alias("_bucket")) for w in widths]
    if len(places) == 1:
        pt = points.withColumns({"_width": places[0]["_width"], "_bucket": places[0]["_bucket"]})
    else:
        pt = points.select("*", F.inline(F.array(*places) if places else F.expr("array_repeat(struct(0 AS _width, 0L AS _bucket), 0)")))
    # a repeated point is as thin as it came: its key is not copied, its time is computed again where it meets
    same = [F.col(f"`{c}`") == F.col(i) for c, i in zip(k, inner)]
    iv = iv.withColumnsRenamed({"_width": "_iv_width", "_bucket": "_iv_bucket"})
    met = pt.join(iv, _and([*same, F.col("_width") == F.col("_iv_width"), F.col("_bucket") == F.col("_iv_bucket")]))
    met = met.where(_clock(points, at, grain).between(F.col("_lo"), F.col("_hi")))
    return met.select(*[F.col(f"`{c}`") for c in points.columns], *[F.col(f"`{c}`") for c in extra])


