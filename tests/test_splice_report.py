"""The registered splice report runs the reference's whole job."""

import os

import pytest
from pyspark.sql import functions as F

from stationlab.plans import catalog
from stationlab.operators import continuity as SP

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_report_has_ten_years_all_samples_and_both_columns(spark):
    cols = ["value", "n_orders"]
    got = catalog.REGISTRY["splice_report"](spark, SF)
    pairs = SP.splice_pairs(catalog.splice_groups(spark, SF), ["key"])
    bins = SP.splice_windows(catalog.splice_panel(spark, SF), pairs, ["key"], "day", cols, window_years=10)
    want = SP.bootstrap_ci(SP.bootstrap_diffs(bins, cols, 2000, catalog.SPLICE_SEED), (0.025, 0.5, 0.975))

    def rows(df):
        return sorted(tuple(r) for r in df.select("group_id", "pair_no", "measure", "statistic",
                                                  *[F.round(q, 4) for q in ("q_2_5", "q_50", "q_97_5")]).na.fill(-1.0).collect())

    got = rows(got)
    assert got == rows(want) and {r[2] for r in got} == set(cols)
