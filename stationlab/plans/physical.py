"""Join-strategy helpers shared by the operators.

Most operators follow one shape: aggregate the big table per key (map-side partial aggregation,
so a key holding a third of all rows costs nothing extra), then attach that per-key result back to
the rows.  The per-key side is broadcast only after its row count is known to be under a bound;
above the bound the join is a shuffle join, and AQE's skew handling splits a hot key's partition
on the big side instead of sending it to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Row bound under which a per-key table is broadcast.  A per-key table here has a handful of
# columns (< 100 bytes a row), so 2 million rows stay well under the broadcast size limit.
BROADCAST_MAX_ROWS = 2_000_000


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows + 1 of them)."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int | None = None, persist: bool = True) -> DataFrame:
    """Return ``df`` ready to be the small side of a join (``max_rows`` defaults to the module's
    ``BROADCAST_MAX_ROWS``, read at call time).

    With ``persist`` the table is checkpointed first, so the size check and the join read the
    same materialised rows instead of computing the aggregate twice.  The broadcast hint is only
    added when the counted size is under ``max_rows``.
    """
    max_rows = BROADCAST_MAX_ROWS if max_rows is None else max_rows
    if persist:
        df = materialize(df)
    return F.broadcast(df) if bounded_rows(df, max_rows) else df


def attach(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner",
           max_rows: int | None = None, persist: bool = True, bound: int | None = None) -> DataFrame:
    """Join a per-key (or otherwise small) table onto a big one with a size-checked broadcast.

    ``bound`` is an upper bound on the small side's rows that the caller has already proven
    (e.g. a per-pair table is at most 2 x the counted pair list): under ``max_rows`` it is
    broadcast directly, without materialising or counting it again."""
    on = list(on) if not isinstance(on, str) else on
    max_rows = BROADCAST_MAX_ROWS if max_rows is None else max_rows
    if bound is not None and bound <= max_rows:
        return big.join(F.broadcast(small), on=on, how=how)
    return big.join(small_side(small, max_rows, persist), on=on, how=how)


def literal_rows(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table built from a Python list: its size is known, so it is safe to broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema=schema))
