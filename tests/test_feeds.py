"""Edges of the feed and pooling operators on small rows."""

import random

from pyspark.sql import functions as F

from jointedge.operators import candidates, entities, markets, sheet

SCHEMES = {"static": (0.15, 0.20, 0.30, 0.35)}
SEASONS = [1, 2, 3, 4]


def test_price_requests_need_both_sides(spark):
    rows = spark.createDataFrame([("e", "a", "b"), ("e", "b", "a"), ("e", "a", None), ("e", None, None)], "event_id string, selection_a string, selection_b string")
    assert [tuple(r) for r in markets.price_requests(rows).collect()] == [("e", "a", "b")]


def test_games_find_their_events_by_an_index(spark):
    """Team first, then both short codes, then all words of both names; each in feed order."""
    events = spark.createDataFrame([(1, 20, "New York Knicks", "Philadelphia 76ers", "NYK", "PHI"), (2, 10, "Boston Celtics", "Philadelphia 76ers", "BOS", "PHI"), (3, 30, "Miami Heat", None, "MIA", None), *((k, k, f"Club {k}", f"Side {k}", f"C{k}", f"S{k}") for k in range(40, 80))], "id long, feed_pos long, homeTeam string, awayTeam string, homeShort string, awayShort string")
    asked = [
        (1, None, "PHI@NYK", (1, 2)), (2, "", "PHI vs BOS", (2, 2)), (3, "76ers", None, (2, 1)), (4, "PHI", "PHI@NYK", (2, 1)), (5, "the Miami Heat!", None, (3, 1)), (6, None, "Philadelphia 76ers @ New York Knicks", (1, 3)),
        (7, "nobody", "side 44 at club 44", (44, 3)), (8, None, None, (None, None)), (9, None, "PHI@MIA", (None, None)), (10, "Club 77", "", (77, 1)),
    ]
    games = spark.createDataFrame([x[:3] for x in asked], "game_id long, team string, game string")
    found = markets.events_of_games(games, events)
    assert {r.game_id: (r.event_id, r.rule) for r in found.collect()} == {x[0]: x[3] for x in asked}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_holding_equals_all_pairs(spark):
    rng = random.Random(1)
    texts = sorted({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(150)})
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    small, big = df.withColumnRenamed("x", "a"), df.withColumnRenamed("x", "b")
    got = markets.holding(small, markets._own_grams(F.col("a")), big, "b", F.col("b").contains(F.col("a")))
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((a, b) for a in texts for b in texts if a in b)


def test_legs_match_markets_of_their_class(spark):
    sel = lambda i, player, outcome, points, name, shelf: (i, f"s{i}", player, outcome, points, name, shelf, "")
    offers = spark.createDataFrame([
        sel(1, "Ann Lee", "Over", 1.5, "Total Bases", "Batter Props"), sel(2, "Ann Lee", "2+", 2.0, "Total Bases o/u", "Main"), sel(3, "Ann Lee", "Over", 20.5, "Player Points", "Points"), sel(4, "Ann Lee", "Over", 20.5, "Points + Rebounds", "Points"),
        sel(5, "Ann Lee", "Over", 2.5, "3-Pointers Made", "Threes"), sel(6, "Ann Lee", "Over", 4.5, "Pitcher Strikeouts", None), sel(7, None, "Over", 4.5, "Pitcher Strikeouts", None), sel(8, "Ann Lee", "Over", 0.5, "Home Runs", "Main"), sel(9, "Ann Lee", "Over", 0.5, "Runs Scored", "Main O/U"),
    ], "feed_pos long, selectionId string, player string, outcomeType string, points double, marketName string, subcategory string, marketType string")
    legs = lambda *rows: spark.createDataFrame([(i, "A. Lee", "Over", t, s) for i, (t, s) in enumerate(rows)], "leg_id long, player string, direction string, threshold double, stat string")
    match = lambda df, **how: [r.selectionId for r in markets.match_legs(df, offers, **how).orderBy("leg_id").collect()]
    assert match(legs((1.5, "Total Bases"), (0.5, "Runs"), (0.5, "HR"), (4.5, "Strikeouts")), kind="batter", prefer_two_way=True) == ["s1", "s9", "s8", None]
    assert match(legs((20.5, "Points"), (2.5, "3-Pointers Made"), (20.5, "Rebounds")), kind="player", half_points=False) == ["s3", "s5", None]
    assert match(legs((4.5, "Strikeouts"), (1.5, "Total Bases"))) == ["s6", None]


def test_the_other_side_goes_by_name_stat_points_and_shelf(spark):
    sel = lambda i, player, outcome, points, name, shelf, price: (i, f"s{i}", player, outcome, points, name, shelf, "", price)
    offers = spark.createDataFrame([
        sel(1, "Ann Lee", "Over", 1.5, "Ann Lee Total Bases", None, "+120"), sel(2, "Bo Lee", "Under", 1.5, "Total Bases", "", "-150"), sel(3, "A. Lee", "Under", 1.5, "Total Bases", "", "-140"), sel(4, "Ann Lee", "Under", 1.5, "Team Total Bases", "", "-1"),
        sel(5, "Ann Lee", "Over", 0.5, "Hits", "Hits O/U", "-200"), sel(6, "Ann Lee", "Under", 0.5, "Hits", "Hits", "+170"), sel(7, "Ann Lee", "Under", 2.5, "RBIs", "x", "+110"),
    ], "feed_pos long, selectionId string, player string, outcomeType string, points double, marketName string, subcategory string, marketType string, oddsAmerican string")
    legs = spark.createDataFrame([(1, "Ann Lee", "Over", 1.5, "Total Bases"), (2, "Ann Lee", "Over", 0.5, "Hits"), (3, "Ann Lee", "Under", 2.5, "RBI"), (4, "Nobody", "Over", 1.5, "Hits"), (5, None, "Over", 1.5, "Hits")], "leg_id long, player string, direction string, threshold double, stat string")
    got = {r.leg_id: (r.selectionId, r.opposite_id, r.over_odds, r.under_odds) for r in markets.leg_sides(legs, offers, "batter").collect()}
    # a null shelf is the empty one; an initial matches; another market text does too; another shelf does not
    assert got == {1: ("s1", "s3", "+120", "-140"), 2: ("s5", None, "-200", None), 3: ("s7", None, None, "+110"), 4: (None,) * 4, 5: (None,) * 4}


def test_row_ids_are_texts_and_books_numbers(spark):
    row = lambda i, **k: tuple({"sheet_id": "a", "idx": i, "L": str(i), "team": None, "game": None, "market": "Player Points", "bet_name": None, "player": "Ann Lee", "direction": "Over", "line": "3.5", "avg_odds": None, "avg_fv": "110", "books_count": None, **k}.values())
    schema = "sheet_id string, idx long, L string, team string, game string, market string, bet_name string, player string, direction string, line string, avg_odds string, avg_fv string, books_count string"
    rows = [row(1, L="A"), row(2, L="A"), row(3, L="7"), row(4, L="07", books_count="3.0"), row(5, L=""), row(6, L=None), row(7, L="7", books_count="9"), row(8, L="8", books_count="x"), row(9, L="9", books_count="2.5")]
    first = sheet.first_rows(sheet.normalised(spark.createDataFrame(rows, schema)))
    assert {r.idx: (r.row_id, r.books) for r in first.collect()} == {1: (None, 0.0), 3: (7.0, 0.0), 4: (7.0, 3.0), 5: (None, 0.0), 6: (None, 0.0), 8: (8.0, 0.0), 9: (9.0, 2.5)}
    assert [r.idx for r in sheet.collapsed(first).collect()] == [4]


def test_players_come_out_of_market_names(spark):
    from jointedge.functions import text

    cases = [
        ("Ann Lee Strikeouts Thrown", "Strikeouts Thrown O/U", "x", "Ann Lee"), ("Ann Lee total bases", "Total Bases", None, "Ann Lee"), ("Ann Lee Points Alt", "Alt", "Points Milestones", "Ann Lee"), ("Ann Lee Hits Allowed", None, "", "Ann Lee"),
        ("Ann Lee 3-Pointers Made", "", None, "Ann Lee"), ("Hits Ann Lee Runs", None, None, "Hits Ann Lee"), ("Ann Lee", "Points", "Points", "Ann Lee"), ("Points", "Points", None, ""), (None, "x", "y", None), ("Moneyline", None, None, "Moneyline"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, market string, kind string, sub string")
    got = {r.i: r.name for r in df.select("i", text.player_of_market(F.col("market"), F.col("kind"), F.col("sub")).alias("name")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_sheets_read_names_and_ties_as_their_kind_does(spark):
    row = lambda i, **k: tuple({"sheet_id": "a", "idx": i, "L": str(i), "team": None, "game": None, "market": "Player Points", "bet_name": "Bo Ray Over 3.5", "player": "Ann Lee", "direction": None, "line": None, "avg_odds": None, "avg_fv": "110", "books_count": None, **k}.values())
    schema = "sheet_id string, idx long, L string, team string, game string, market string, bet_name string, player string, direction string, line string, avg_odds string, avg_fv string, books_count string"
    rows = spark.createDataFrame([row(1, player=" "), row(2, market="Player Steals"), row(3, market="Points"), row(4, market="x"), row(5, books_count="0", team="T", L="9")], schema)
    got = {r.idx: (r.player, r.reason) for r in sheet.normalised(rows).collect()}
    assert got == {1: (None, "no player name"), 2: ("Ann Lee", "unsupported_prop (no correlation data)"), 3: ("Ann Lee", None), 4: ("Ann Lee", "unknown NBA market"), 5: ("Ann Lee", None)}
    kept = sheet.collapsed(sheet.first_rows(sheet.normalised(rows).where("reason is null")))
    assert [(r.idx, r.seen) for r in kept.collect()] == [(5, 3)]  # no books are 0 books, then the larger row id
    told = sheet.players(sheet.props(kept)).first()
    assert (told.team, told.game, len(told.props)) == ("T", None, 1)
    one = sheet.normalised(spark.createDataFrame([row(1, market="Strikeouts", line="5.5", direction="u")], schema), "pitcher").first()
    assert (one.player, one.direction, one.line, one.disagree, one.reason) == ("Bo Ray", "Over", 3.5, True, None)


def test_names_match_when_folded(spark):
    names = spark.createDataFrame([("José  Ruiz",), ("José  Ruiz",), ("Ann Lee",), (None,)], "player string")
    known = spark.createDataFrame([("jose ruiz",)], "player string")
    assert {(r.player, r.matched) for r in candidates.matched_names(names, known).collect()} == {("José  Ruiz", True), ("Ann Lee", False), (None, False)}


def test_events_of_players_take_the_first_in_feed_order(spark):
    props = spark.createDataFrame([("A. Stone", 2, "late"), ("Al Stone", 1, "early"), ("Bo Lee", 3, "other")], "player string, feed_pos long, eventId string")
    players = spark.createDataFrame([("AL STONE",), ("Cy Lee",), ("",)], "player string")
    assert {(r.player, r.event_id) for r in markets.player_events(players, props).collect()} == {("AL STONE", "early"), ("Cy Lee", None), ("", None)}


def test_pooled_raw_of_few_and_constant_rows(spark):
    rows = [(4, "one", 1, 2), (4, "flat", 5, 1), (3, "flat", 5, 2), (2, "flat", 5, 9), (4, "up", 1, 1), (3, "up", 2, 2), (4, "gap", None, 1), (3, "gap", 1, 1)]
    raw = entities.raw_sums(spark.createDataFrame(rows, "season int, p string, x long, y long"), ["x", "y"])
    got = {r.p: r.r for r in entities.pooled_raw(raw, SCHEMES, SEASONS).collect()}
    assert got == {"one": None, "flat": None, "up": 1.0, "gap": None}


def test_pooled_triples_against_weighted_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(s), "a", *map(int, rng.integers(0, 4, 3))) for s in rng.choice([1, 2, 4], 60)]
    legs = [("Over", 1.5, "x"), ("Over", 0.5, "y"), ("Under", 2.5, "z")]
    counts = entities.triple_counts(entities.masks(spark.createDataFrame(rows, "season int, p string, x long, y long, z long"), legs), entities.combos_of(legs, 3))
    got = entities.pooled_triples(counts, legs, SCHEMES, SEASONS).first()
    season_weight = {1: 0.15 * 0.65 / 0.35, 2: 0.20 * 0.65 / 0.35, 4: 0.35}
    w = np.array([season_weight[r[0]] for r in rows])
    hit = np.array([[r[2] > 1.5, r[3] > 0.5, r[4] < 2.5] for r in rows], float).T
    cov = np.cov(hit, aweights=w, bias=True)
    assert abs(got.r12 - cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1])) < 1e-4
    assert abs(got.r23 - cov[1, 2] / np.sqrt(cov[1, 1] * cov[2, 2])) < 1e-4
    assert abs(got.all3 - 100 * (w * hit.prod(axis=0)).sum() / w.sum()) < 0.051


def test_legs_of_several_reports_are_named_once(spark):
    one = spark.createDataFrame([("a", "b"), ("b", "c")], "leg1 string, leg2 string")
    two = spark.createDataFrame([("c", "d", "a")], "leg1 string, leg2 string, leg3 string")
    assert sorted(r.leg for r in entities.distinct_legs(one, two).select(F.col("leg")).collect()) == ["a", "b", "c", "d"]
