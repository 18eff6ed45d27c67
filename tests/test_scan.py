"""Running totals over slices against a plain loop."""

from __future__ import annotations

import random

import pytest

from tonegauge.operators.scan import running

ROWS = "g string, k bigint, v bigint, x string"


def plain(rows, xor):
    total, out = {}, []
    for g, k, v, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
        before = total.get(g, 0)
        total[g] = before ^ (v or 0) if xor else before + (v or 0)
        out.append((g, k, v, x, total[g]))
    return out


@pytest.mark.parametrize("xor", [False, True])
@pytest.mark.parametrize("slices", [1, 7])
def test_running_totals_cross_slices(spark, xor, slices):
    draw = random.Random(slices)
    groups = ["a"] * 6 + ["b", "c", None, "d", "e"]
    rows = [(draw.choice(groups), i if i != 7 else None, draw.choice([None, 0, 5, -3, 2**40]), "x") for i in range(400)]
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    found = running(frame, ["g", "k"], {"upto": (["g"], "v")}, xor=xor, slices=slices)
    assert found.columns == ["g", "k", "v", "x", "upto"]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(rows, xor), key=key)


def test_two_groupings_of_one_order(spark):
    rows = [(g, k, 1, str(k % 3)) for g in "abc" for k in range(50)]
    frame = spark.createDataFrame(rows, ROWS)
    found = running(frame, ["g", "x", "k"], {"whole": (["g"], "v"), "part": (["g", "x"], "v")}, slices=6).collect()
    for g in "abc":
        mine = sorted((r for r in found if r.g == g), key=lambda r: (r.x, r.k))
        assert [r.whole for r in mine] == list(range(1, 51))
        assert [r.part for r in mine] == [*range(1, 18), *range(1, 18), *range(1, 17)]


def test_running_of_nothing(spark):
    assert running(spark.createDataFrame([], ROWS), ["g"], {"upto": (["g"], "v")}).collect() == []
