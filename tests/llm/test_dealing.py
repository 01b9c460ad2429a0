"""Queries whose ids share a divisor are spread over all blocks."""

import collections

from stationlab.llm.vector_search import dealt


def test_queries_are_spread():
    for blocks in (1, 2, 5, 10, 25, 50):
        n = collections.Counter(dealt(50 * i, blocks) for i in range(10_000))
        assert len(n) == blocks and max(n.values()) < 1.5 * 10_000 / blocks
