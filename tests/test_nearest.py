"""Nearest rows by cells against plain comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import nearest as nr


def plain(rows, asked, k):
    out = set()
    for q, v in asked:
        d = [(sum((a - b) ** 2 for a, b in zip(x, v)), i) for i, x in rows if i != q]
        d = sorted((float("inf") if s != s else s, i) for s, i in d)[:k]
        out |= {(q, i, s, r) for r, (s, i) in enumerate(d, 1)}
    return out


@pytest.mark.parametrize("size", [5, 2048])
def test_cells_give_all_ties_copies_and_odd_numbers(spark, monkeypatch, size):
    monkeypatch.setattr(nr, "CELL_ROWS", size)
    rng = np.random.default_rng(2)
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.integers(0, 12, (150, 2)))]
    rows += [(1000 + i, [3.0, 3.0]) for i in range(20)] + [(7, [5.0, 5.0]), (7, [5.0, 5.0]), (8, [0.5, 0.5])]
    rows += [(2000, [float("nan"), 1.0]), (2001, [float("inf"), 1.0]), (2002, [-0.0, 0.0]), (2003, [1e6, 1e6])]
    asked = [r for r in rows if r[0] % 5 == 0 or r[0] in (7, 8, 2001, 2002, 2003)]
    asked = list({i: (i, v) for i, v in asked}.values())
    make = lambda x: spark.createDataFrame(x, "id long, v array<double>").repartition(3)
    got = {tuple(r) for r in nr.nearest(make(rows), make(asked), "id", F.col("v"), 4).collect()}
    assert got == plain(rows, asked, 4)


def test_work_grows_with_the_rows_not_with_their_square():
    rng = np.random.default_rng(1)
    for n in (4_000, 64_000):
        x = rng.random((n, 2))
        tree = nr._split(x, 250)
        who, cells = nr._reach(tree, x[:500], np.full(500, 10.0 / n))
        assert len(who) < 500 * 8 and set(zip(range(500), nr._home(tree, x[:500]))) <= set(zip(who, cells))
        assert np.bincount(nr._home(tree, x)).max() <= 250


def test_nothing_to_ask(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    some = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    assert nr.nearest(some, none, "id", F.col("v"), 3).count() == nr.nearest(none, some, "id", F.col("v"), 3).count() == nr.nearest(some, some, "id", F.col("v"), 3).count() == 0
