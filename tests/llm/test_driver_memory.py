"""What the driver holds: freed memory goes back to the system, members of blocks are broadcast in bounds."""

import ctypes
import random
import re
from pathlib import Path

import numpy as np
import pytest

from stationlab.llm import common, jaccard_join

WORDS = [f"w{i}" for i in range(400)]


def held_mb():
    return int(re.search(r"\nVmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="another C library")
def test_freed_memory_goes_back_when_a_table_is_written(spark):
    df = spark.range(10)
    common.written(df)
    blocks = [np.ones(2000, np.int32) for _ in range(20_000)]
    last = blocks[-1]
    full = held_mb()
    del blocks
    assert common.written(df).count() == 10
    assert held_mb() < full - 100 and last.sum() == 2000


def near_copies(seed, n):
    """Texts of which many are linked, some only by way of others."""
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        words = r.choices(WORDS, k=40)
        for _ in range(r.randint(1, 6)):
            texts.append(" ".join(words))
            words = [*words[1:], r.choice(WORDS)]
    return [(i, t) for i, t in enumerate(r.sample(texts, len(texts)))]


def test_members_of_blocks_are_broadcast_by_their_cells(spark, monkeypatch):
    docs = spark.createDataFrame(near_copies(1, 30), "doc_id long, text string")
    want = sorted(map(tuple, jaccard_join.jaccard_components(docs, percent=80).collect()))
    wide = []

    def checked(df, max_rows=common.BROADCAST_ROWS):
        if len(df.columns) > 4:
            wide.append((len(df.columns), max_rows))
            return df  # as beyond the bound
        return common.checked(df, max_rows)

    monkeypatch.setattr(jaccard_join, "checked", checked)
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs, percent=80).collect())) == want
    assert len({c for _, _, c in want}) < len(want)
    assert wide and all(columns * rows <= 2 * common.BROADCAST_ROWS for columns, rows in wide)
