"""Triples from shrunk pairs on worked values."""

import pytest

from jointedge.operators import entities


def test_triples_take_the_pairs_that_are_there(spark):
    legs = [("Over", 1.5, "A"), ("Over", 2.5, "B"), ("Under", 3.5, "C"), ("Under", 4.5, "D")]
    a, b, c, d = map(entities.leg_name, legs)
    rows = [(1, a, b, 0.3), (1, a, c, 0.6), (1, b, c, None), (1, a, d, None), (1, b, d, None), (1, c, d, -0.2)]
    rows += [(p, x, y, None) for p in (2, None) for _, x, y, _ in rows]
    shrunk = spark.createDataFrame(rows, "p long, leg1 string, leg2 string, r double")
    got = {(r.p, r.leg1, r.leg2, r.leg3): r.r for r in entities.shrunk_triples(shrunk, legs).collect()}
    assert len(got) == 8 and {p for p, *_ in got} == {1, 2}
    assert got[1, a, b, c] == pytest.approx(0.45) and got[1, a, b, d] == pytest.approx(0.3)
    assert got[1, a, c, d] == pytest.approx(0.2) and got[1, b, c, d] == pytest.approx(-0.2)
    assert all(r is None for (p, *_), r in got.items() if p == 2)
