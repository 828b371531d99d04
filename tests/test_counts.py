"""Counts of combos on small rows against plain loops, and what their plans shuffle."""

import random
import re
from itertools import combinations

import pytest

from jointedge.operators import entities
from jointedge.plans.queries import QUERIES

STATS = ["x", "y", "z"]
#: More legs than a mask's word has bits.
LEGS = [(way, low + 0.5, s) for s in STATS for low in range(12) for way in ("Over", "Under")]
KEYS = r"Exchange hashpartitioning\(([^)]*)\)"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    some = lambda *v: rng.choice(v)
    return [(some(1, 2, None), some("a", "b", "c", None), *(some(None, *range(13)) for _ in STATS)) for _ in range(120)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "season int, p string, x long, y long, z long")


def holds(row, leg):
    v = row[2 + STATS.index(leg[2])]
    return v is not None and (v > leg[1] if leg[0] == "Over" else v < leg[1])


def near(v):
    return round(v, 4) if isinstance(v, float) else v


def r_of(n, a, b, both):
    return None if 0 in (a, b) or n in (a, b) else round((n * both - a * b) / ((a * (n - a)) * (b * (n - b))) ** 0.5, 4)


def share(k, n):
    return (k * 2000 + n) // (2 * n) / 10


def test_spec_triples_count_masks_and_no_entities(spark, sf_dir):
    plan = QUERIES["spec_triples"](spark, sf_dir)._jdf.queryExecution().toString()
    assert all("p#" not in k for k in re.findall(KEYS, plan))


def test_season_triples_against_loops(table, rows):
    combos = [(0, 70, 3, 30), (1, 30, 65, 1), (2, 61, 62, 63), (3, 5, 5, 40)]
    want = []
    for season in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == season and r[1] is not None]
        for _, *legs in combos:
            hit = [[holds(r, LEGS[k]) for k in legs] for r in of]
            n, count = len(of), lambda *which, hit=hit: sum(all(h[i] for i in which) for h in hit)
            want.append((season, *(entities.leg_name(LEGS[k]) for k in legs), n, *(r_of(n, count(i), count(j), count(i, j)) for i, j in ((0, 1), (0, 2), (1, 2))), share(count(0, 1, 2), n), share(sum(not any(h) for h in hit), n)))
    got = [tuple(map(near, r)) for r in entities.season_triples(table, LEGS, combos).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == 12
    assert entities.season_triples(table, LEGS, []).collect() == []


def test_spec_pairs_keep_of_entities_only_their_number(spark, sf_dir):
    plan = QUERIES["spec_pairs"](spark, sf_dir)._jdf.queryExecution().toString()
    assert all("p#" not in k or k.count("#") == 2 for k in re.findall(KEYS, plan))


def test_season_pairs_against_loops(table, rows):
    combos = [(0, 70, 3), (1, 30, 65), (2, 61, 62), (3, 5, 5)]
    want = []
    for season in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == season and r[1] is not None]
        for _, a, b in combos:
            n, k = len(of), [sum(holds(r, LEGS[a]) for r in of), sum(holds(r, LEGS[b]) for r in of), sum(holds(r, LEGS[a]) and holds(r, LEGS[b]) for r in of)]
            want.append((season, entities.leg_name(LEGS[a]), entities.leg_name(LEGS[b]), n, len({r[1] for r in of}), r_of(n, *k), *(share(v, n) for v in k)))
    got = [tuple(map(near, r)) for r in entities.season_pairs(table, LEGS, combos).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and None in {r[0] for r in got}


def test_entity_triples_shuffle_masks_and_no_combos(spark, sf_dir):
    plan = QUERIES["entity_triples"](spark, sf_dir)._jdf.queryExecution().toString()
    assert all("idx#" not in k for k in re.findall(KEYS, plan))


@pytest.mark.parametrize("at_once", [64, 2])
def test_entity_triples_count_against_loops(table, rows, monkeypatch, at_once):
    monkeypatch.setattr(entities, "AT_ONCE", at_once, raising=False)
    combos = [(0, 70, 3, 30), (1, 30, 65, 1), (2, 61, 62, 63), (3, 5, 5, 40), (4, 0, 1, 2)]
    want = []
    for season, p in {r[:2] for r in rows if r[1] is not None}:
        of = [r for r in rows if r[:2] == (season, p)]
        for idx, *legs in combos:
            hit = [[holds(r, LEGS[k]) for k in legs] for r in of]
            sums = [sum(all(h[i] for i in v) for h in hit) for k in (1, 2, 3) for v in combinations(range(3), k)]
            want.append((season, p, idx, *legs, len(of), *sums, sum(not any(h) for h in hit)))
    counts = entities.triple_counts(entities.masks(table, LEGS), combos)
    assert counts.columns == ["season", "p", "idx", "a", "b", "c", *entities.TRIPLE_SUMS]
    assert sorted(map(tuple, counts.collect()), key=repr) == sorted(want, key=repr)
    assert entities.triple_counts(entities.masks(table, LEGS), []).collect() == []


def test_global_triples_shuffle_no_combo_of_an_entity(spark, sf_dir):
    plan = QUERIES["global_triples"](spark, sf_dir)._jdf.queryExecution().toString()
    assert all("p#" not in k or "a#" not in k for k in re.findall(KEYS, plan))


def test_distinct_legs_shuffle_no_slot_of_an_entity(spark, sf_dir):
    plan = QUERIES["distinct_legs"](spark, sf_dir)._jdf.queryExecution().toString()
    assert all("slot#" not in k and "idx#" not in k for k in re.findall(KEYS, plan))


def test_pair_report_margins_take_rows_that_have_both(table, rows):
    """Pairs against loops: the margin of two stats is over the rows of an entity's season that have both, whatever else they lack."""
    legs, combos = [("Over", 5.5, "x"), ("Under", 7.5, "y"), ("Over", 3.5, "z"), ("Under", 4.5, "x")], [(7, 0, 1), (8, 2, 0), (9, 0, 3), (11, 3, 2)]

    def pearson(of, a, b):
        v = [(r[2 + STATS.index(a)], r[2 + STATS.index(b)]) for r in of]
        v = [k for k in v if None not in k]
        n, x, y, xx, yy, xy = len(v), *(sum(f(*k) for k in v) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a * a, lambda a, b: b * b, lambda a, b: a * b))
        vx, vy = n * xx - x * x, n * yy - y * y
        return round((n * xy - x * y) / (vx * vy) ** 0.5, 4) if n > 1 and vx > 0 and vy > 0 else None

    want = {}
    for season, p in {r[:2] for r in rows if r[1] is not None}:
        of = [r for r in rows if r[:2] == (season, p)]
        for _, a, b in combos:
            k = [sum(holds(r, legs[v]) for r in of) for v in (a, b)]
            told = (len(of), r_of(len(of), *k, sum(holds(r, legs[a]) and holds(r, legs[b]) for r in of)), pearson(of, legs[a][2], legs[b][2]))
            if legs[a][2] != legs[b][2] and told[1:] != (None, None):
                want[season, p, entities.leg_name(legs[a]), entities.leg_name(legs[b])] = told
    got = {(r.season, r.p, r.leg1, r.leg2): (r.n, near(r.r), near(r.r_margin)) for r in entities.pair_report(table, legs, combos, STATS).collect()}
    assert got == want and len(got) == 27
