"""Tiled correlation and rows at the maximum against brute force."""

import datetime as dt
import random

import numpy as np
import pytest

from stationlab.operators import stats as A
from stationlab.operators import tiles


def brute(rows):
    cells = {}
    for g, p, v in rows:
        if g is not None and p is not None and v is not None:
            cells.setdefault((g, p), []).append(v)
    cells = {c: sum(v) / len(v) for c, v in cells.items()}
    groups = sorted({g for g, _ in cells})
    out = {}
    for a in groups:
        for b in groups:
            common = [p for g, p in cells if g == a and (b, p) in cells]
            if common:
                x, y = [np.array([cells[g, p] for p in common]) for g in (a, b)]
                moves = len(common) > 1 and np.ptp(x) > 0 and np.ptp(y) > 0
                out[a, b] = (np.corrcoef(x, y)[0, 1] if moves else None, len(common))
    return out


@pytest.mark.parametrize("tile, chunk", [(1, 1), (3, 7), (64, 512)])
def test_corr_in_tiles(spark, tile, chunk):
    r = random.Random(3)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    rows = [("hot", day(r.randint(0, 40)), r.gauss(1e6, 1)) for _ in range(250)]
    rows += [(f"g{r.randint(0, 9)}", day(r.randint(0, 40)), r.choice([None, r.gauss(0, 1), r.gauss(50, 20)])) for _ in range(350)]
    rows += [("flat", day(n), 3.3) for n in range(30)] + [("once", day(5), 1.0), ("apart", day(900), 1.0), ("apart", day(901), 2.0),
             (None, day(1), 5.0), ("g1", None, 5.0)]
    got = tiles.corr_matrix(spark.createDataFrame(rows, "g string, p date, v double"), "g", "p", "v", tile, chunk)
    got = {(x.group_a, x.group_b): (x["corr"], x.n_common) for x in got.collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for pair, (c, n) in want.items():
        assert got[pair][1] == n
        assert got[pair][0] == (None if c is None else pytest.approx(c, abs=1e-7)), pair


def test_blocks_are_bounded_and_numbered_once(spark):
    df = spark.range(1000).selectExpr("concat('s', id % 333) AS s")
    got = tiles.numbered(df, "s", 10, "b").collect()
    assert len({x.s for x in got}) == len(got) == 333 and len({(x.b, x.b_at) for x in got}) == 333
    assert max(x.b_at for x in got) < 10


def test_corr_of_nothing(spark):
    none = spark.createDataFrame([], "g string, p date, v double")
    assert tiles.corr_matrix(none, "g", "p", "v").columns == ["group_a", "group_b", "corr", "n_common"]
    assert tiles.corr_matrix(none, "g", "p", "v").count() == 0


@pytest.mark.parametrize("kind", ["text", "date", "number"])
@pytest.mark.parametrize("ties", [(), ("id",)])
def test_row_at_max_keeps_every_group(spark, kind, ties):
    make = {"text": lambda n: f"t{n}", "date": lambda n: dt.date(2000, 1, 1 + n), "number": float}[kind]
    rows = [(None, make(1), 1), (None, make(3), 2), ("a", None, 3), ("a", None, 4), ("b", make(5), 6), ("b", None, 0), ("b", make(2), 5)]
    if ties:
        rows += [("b", make(5), 9)]
    df = spark.createDataFrame(rows, f"g string, v {dict(text='string', date='date', number='double')[kind]}, id int")
    got = {x.g: (x.v, x.id) for x in A.row_at_max(df, "v", ["g"], ties).collect()}
    assert got[None] == (make(3), 2) and got["b"] == (make(5), 6) and got["a"][0] is None and set(got) == {None, "a", "b"}
    whole = A.row_at_max(df, "v", None, ties).collect()
    assert [(x.g, x.id) for x in whole] == [("b", 6)]
