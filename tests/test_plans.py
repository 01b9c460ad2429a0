"""Plan-shape checks over every registered driver query: no window runs over raw rows.

A ``Window.partitionBy(key)`` over raw rows sends a hot key's whole series to one task.  The
library only windows aggregated tables (bins, (key, year) totals, group lists), so between any
Window operator and a parquet scan there must be an aggregate.  Two kinds of exception are part
of the design: the splice queries window the station group list (the groups table itself, a
few rows per group), and a per-group top-k carries a partial WindowGroupLimit below its shuffle,
so each task sends at most k rows per group.
"""

import pytest

SF = "/root/testdata/sf0.001"
AGGREGATES = ("HashAggregate", "ObjectHashAggregate", "SortAggregate")
GROUP_LIST_QUERIES = {"splice_pairs", "splice_order", "splice_report", "largest_shifts"}  # the last sorts the report


def _children(node):
    cs = node.children()
    return [cs.apply(i) for i in range(cs.size())]


def _scan_below(node, seen_limit=False):
    """(table path, a partial WindowGroupLimit was passed) for the first parquet scan reached
    from ``node`` without crossing an aggregate, or None."""
    name = node.nodeName()
    if name.startswith(AGGREGATES):
        return None
    if name == "WindowGroupLimit":
        seen_limit = True
    if name.startswith("Scan parquet") or name == "FileSourceScan":
        return node.toString(), seen_limit
    for c in _children(node):
        hit = _scan_below(c, seen_limit)
        if hit:
            return hit
    return None


def _windows_over_scans(node, out):
    if node.nodeName() == "Window":
        for c in _children(node):
            hit = _scan_below(c)
            if hit:
                out.append(hit)
    for c in _children(node):
        _windows_over_scans(c, out)
    return out


def test_no_window_over_raw_rows(spark):
    import __spark_entry__ as E

    bad = {}
    for name, fn in E.queries().items():
        hits = _windows_over_scans(fn(spark, SF)._jdf.queryExecution().sparkPlan(), [])
        for scan, limited in hits:
            if limited:
                continue                                        # per-group top-k, pruned map-side
            if name in GROUP_LIST_QUERIES and "customer.parquet" in scan:
                continue                                        # the splice group list
            bad.setdefault(name, []).append(scan[:160])
    assert not bad, bad


@pytest.mark.parametrize("name", ["top_k_by_group"])
def test_group_top_k_is_pruned_before_the_shuffle(spark, name):
    import __spark_entry__ as E

    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
