"""Scalars on worked values and as properties."""

import pytest
from pyspark.sql import functions as F

from jointedge.functions import joint, odds, shrink, text
from jointedge.operators import moments, sheet, uploads, weights
from jointedge.sources import tables


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_worked_values(spark):
    lit = lambda x: F.lit(x).cast("double")
    r = one(
        spark, a=joint.joint_frechet(lit(0.5), lit(0.5), lit(0.4)), b=joint.joint_frechet(lit(0.5), lit(0.5), lit(None)), c=joint.joint_frechet(lit(0.5), lit(0.5), lit(-0.4)), d=text.ip_to_outs(lit(5.2)), e=text.ip_to_outs(lit(0.2)), f=text.ip_to_outs(lit(5.5)),
        g=odds.american_to_prob(F.lit(120)), h=odds.american_to_prob(F.lit(-150)), i=odds.american_to_prob(F.lit(0)), j=odds.parse_american(F.lit("−150")), k=odds.parse_american(F.lit("+120")), l=text.season_label(F.to_date(F.lit("2025-08-01"))), m=text.season_label(F.to_date(F.lit("2000-07-31"))),
        n=odds.prob_to_american(lit(0.6)), o=odds.decimal_to_american(lit(1.5)), p=text.parse_leg(F.lit("Over 4.5 Total Bases")), q=text.parse_leg(F.lit("nothing")),
    )
    assert (round(r.a, 9), r.b, round(r.c, 9), r.d, r.e, r.f) == (0.35, 0.25, 0.15, 17, 2, 16)
    assert (round(r.g, 4), r.h, r.i, r.j, r.k, r.l, r.m, r.n, r.o) == (0.4545, 0.6, None, -150, 120, "2025-26", "1999-00", -150, -200)
    assert tuple(r.p) == ("Over", 4.5, "Total Bases") and r.q is None


def test_frechet_inverts_and_attribution_adds_up(spark):
    df = spark.range(400).select(((F.col("id") % 19 + 1) / 20).alias("pa"), ((F.col("id") % 17 + 1) / 18).alias("pb"), ((F.col("id") % 21 - 10) / 11).alias("r"))
    x = df.withColumn("j", joint.joint_frechet(F.col("pa"), F.col("pb"), F.col("r"))).withColumn("inv", joint.inverse_joint_frechet(F.col("pa"), F.col("pb"), F.col("j"))).withColumn("att", joint.ev_attribution(F.col("pa"), F.col("pb"), F.col("r"), F.lit(3.0)))
    for row in x.collect():
        assert abs(row.inv.r - row.r) < 1e-9 and row.inv.clamp is None
        assert abs(row.att.total - row.att.from_legs - row.att.from_corr) < 1e-9


def test_names(spark):
    names = ["Giménez", "  GIMENEZ  ", "José Ramírez", None, "", "O'Hoppe"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {r.i: (r.k, r.p) for r in df.select("i", text.fold_key(F.col("n")).alias("k"), text.plain_name(F.col("n")).alias("p")).collect()}
    assert got == {0: ("gimenez", "gimnez"), 1: ("gimenez", "gimenez"), 2: ("jose ramirez", "jos ramrez"), 3: ("", ""), 4: ("", ""), 5: ("o hoppe", "ohoppe")}
    r = one(spark, a=text.names_match(F.lit("kris bubic"), F.lit("k bubic")), b=text.names_match(F.lit("bubic"), F.lit("kris bubic")), c=text.names_match(F.lit("a li"), F.lit("b li")), d=text.nickname(F.lit("New York Yankees"), ["new", "york"]))
    assert (r.a, r.b, r.c, r.d) == (True, True, False, "yankees")


def test_pin_rule(spark):
    w = [F.lit(x) for x in (0.2, 0.25, 0.4, 0.15)]
    case = lambda *on: [F.lit(x) for x in on]
    r = one(spark, a=F.array(*weights.normalised(case(False, True, True, True), w, F.lit(True))), b=F.array(*weights.normalised(case(False, False, False, True), w, F.lit(True))), c=F.array(*weights.normalised(case(True, True, False, False), w, F.lit(True))))
    assert [round(v, 6) for v in r.a] == [0, 0.326923, 0.523077, 0.15] and list(r.b) == [0, 0, 0, 1] and [round(v, 6) for v in r.c] == [0.444444, 0.555556, 0, 0]


def test_moments(spark):
    df = spark.createDataFrame([(1, 2), (2, 4), (3, None), (4, 8)], "x long, y long")
    sums = df.agg(*moments.pair_sums(F.col("x"), F.col("y"))).select(moments.pearson(*(F.col(k) for k in ("n", "x", "y", "xx", "yy", "xy"))).alias("r")).first()
    assert sums.r == 1
    r = one(spark, a=moments.phi(F.lit(4), F.lit(2), F.lit(2), F.lit(2)), b=moments.phi(F.lit(4), F.lit(4), F.lit(2), F.lit(2)), c=moments.percent(F.lit(1), F.lit(16)), d=moments.percent(F.lit(0), F.lit(0)))
    assert (r.a, r.b, r.c, r.d) == (1.0, None, 6.3, None)


def test_shrinkage(spark):
    r = one(spark, a=shrink.resolve_dyad_r(F.lit(0.4), F.lit(0.1), F.lit(True), F.lit(80)), b=shrink.resolve_dyad_r(F.lit(0.4), F.lit(None).cast("double"), F.lit(False), F.lit(80)), c=shrink.shrunk_entity_r(F.lit(0.5), F.lit(0.1), F.lit(50.0)))
    assert (round(r.a.r, 9), r.a.fallback, r.b.r, r.b.fallback, round(r.c, 9)) == (0.25, False, 0.0, True, 0.3)


SHEET = [
    (1, "Donovan Mitchell", "Player Points", "Over", "27.5", "+135 / -170", "120", "7"), (2, "Donovan Mitchell", "Player Points", "Under", "27.5", "+135 / -170", "-150", "7"), (3, "Donovan Mitchell", "Player Rebounds", "Over", "4.5", "-145 / +125", "-140", "5"),
    (4, "Jayson Tatum", "Player Steals", "Over", "1.5", "+110 / -130", "108", "4"), (5, "Jayson Tatum", "Player Points + Rebounds + Assists", "Over", "40.5", "-115 / -105", "-108", "6"), (6, "Jayson Tatum", "Player Assists", "Over", "5.5", "+115 / -135", "-135", "6"),
    (7, "Jayson Tatum", "Player Assists", "Over", "5.5", "+115 / -135", "102", "8"), (8, "Unknown Guy", "Player 3-Pt Made", "Over", "2.5", "+160 / -200", "180", "3"), (9, "", "Player Points", "Over", "20.5", "-110 / -110", "100", "2"),
]


def test_sheet(spark):
    rows = [("s", i, str(i), p, "T", "G", m, None, d, ln, o, fv, b) for i, p, m, d, ln, o, fv, b in SHEET]
    df = spark.createDataFrame(rows, "sheet_id string, idx int, L string, player string, team string, game string, market string, bet_name string, direction string, line string, avg_odds string, avg_fv string, books_count string")
    x = sheet.normalised(df)
    kept = sheet.collapsed(sheet.first_rows(x.where("reason is null")))
    assert x.where("reason is null").count() == 6 and {r.row_id for r in kept.collect()} == {1, 2, 3, 7, 8}
    assert {r.row_id for r in x.where("suspicious").collect()} == {6}
    records = sheet.props(kept)
    assert records.where("over_L = 1 and under_L = 2").count() == 1 and sheet.players(records).count() == 3


def test_required_columns_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, ` name ` string")
    with pytest.raises(ValueError, match="missing columns: other"):
        tables.renamed(df, {"other": "o"})
    assert tables.renamed(df, {"name": "n"}).columns == ["n"]
    with pytest.raises(ValueError, match="missing columns"):
        uploads.validated(df)
    store = tables.Snapshots(spark, f"file://{tmp_path}/s", keep=3)
    for i in range(5):
        store.publish(spark.createDataFrame([(i,)], "v long"))
    assert store.versions() == [3, 4, 5] and store.current("v long").first().v == 4
    assert store.roll_back() == 4 and store.current("v long").first().v == 3
    assert store.versions() == [3, 4] and store.publish(spark.createDataFrame([(9,)], "v long"), reasons={"odd": 2}) == 7
    assert store.versions() == [3, 4, 7] and store.about() == {"version": 7, "rows": 1, "shares": [], "reasons": {"odd": 2}} and store.roll_back() == 4


def test_publishers_at_once_and_failed_ones(spark, tmp_path, monkeypatch):
    one = lambda v: spark.createDataFrame([(v,)], "v long")
    a, b = (tables.Snapshots(spark, f"file://{tmp_path}/s") for _ in range(2))
    a.publish(one(1))
    real = a._numbers
    calls = []

    def late():  # another publisher takes the number between the look and the pointer
        found = real()
        if not calls:
            calls.append(b.publish(one(2)))
        return found

    monkeypatch.setattr(a, "_numbers", late)
    assert a.publish(one(3)) == 3 and calls == [2]
    monkeypatch.undo()
    assert a.versions() == [1, 2, 3] and a.current("v long").first().v == 3
    monkeypatch.setattr(b, "_point", lambda told: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        b.publish(one(4))
    monkeypatch.undo()
    (tmp_path / "s/pointers/00000004").write_text("")  # a publisher that failed while it made its pointer
    assert a.current("v long").first().v == 3 and a.versions() == [1, 2, 3] and a.publish(one(5)) == 5 and a.versions() == [1, 2, 3, 5]


def test_a_failing_gate_publishes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(s, i) for s in (1, 2) for i in range(10)] + [(2, 99)], "season int, x long")
    store = tables.Snapshots(spark, f"file://{tmp_path}/s")

    def build(gate):
        out = gate.watch(rows).where("x < 3").groupBy("season").agg(F.count("*").alias("n"))
        assert str(out._jdf.queryExecution().executedPlan().toString()).count("Scan") <= 1
        return store.publish(out, (gate,), source="test")

    assert build(tables.Gate([1, 2], F.col("x") < 3, None, 0.0, 0.35)) == 1
    assert store.about()["shares"] == [{"1": [3, 10], "2": [3, 11]}] and store.about()["rows"] == 2
    for gate in (tables.Gate([1, 2], F.col("x") < 3, None, 0.0, 0.3), tables.Gate([1], F.col("x") < 3), tables.Gate([1, 2, 3], F.col("x") < 3)):
        with pytest.raises(ValueError, match="season|other"):
            build(gate)
    assert store.versions() == [1] and len(list((tmp_path / "s/data").iterdir())) == 1


def test_exports_lie_in_bounded_files_and_are_pruned(spark, tmp_path):
    from pyspark.sql import types as T

    rows = spark.range(900).select(F.when(F.col("id") < 850, "big").otherwise("small").alias("scheme"), F.col("id").alias("p"), F.col("id").alias("v"))
    path = f"file://{tmp_path}/export"
    tables.export_nested(rows, ["p"], path, rows=40)
    ranges = spark.read.parquet(f"{path}/{tables.RANGES}").collect()
    assert max(r.documents for r in ranges) <= 40 and sum(r.documents for r in ranges) == 900 and len(ranges) >= 23
    schema = T.StructType.fromDDL("p bigint, combos array<struct<v: bigint>>, scheme string")
    found = tables.read_export(spark, path, schema, "big", (700,))
    assert len(found.inputFiles()) == 1 and [(r.p, r.combos[0].v) for r in found.collect()] == [(700, 700)]
    assert tables.read_export(spark, path, schema, "small", (700,)).count() == 0 and spark.read.schema(schema).json(path).count() == 900


def test_combos_of_one_entity_spread_over_keys(spark):
    from itertools import combinations

    from jointedge.operators import markets

    legs = [f"Over {i}.5 {s}" for i in range(9) for s in ("Walks", "Strikeouts", "Hits")]
    rows = spark.createDataFrame([("a", x) for x in legs + legs[:3]] + [(None, "Over 1.5 Hits"), (None, "Over 2.5 Outs"), ("b", "Over 1.5 Hits"), ("b", None)], "player string, leg string")
    order = sorted(legs, key=lambda x: ({"Walks": "BB", "Strikeouts": "SO", "Hits": "H"}[x.split()[-1]], x))
    for size in (2, 3):
        for share in (4, 64):
            got = sorted((tuple(r) for r in markets.leg_combos(rows, size, share).collect()), key=str)
            assert got == sorted([("a", *c) for c in combinations(order, size)] + ([(None, "Over 1.5 Hits", "Over 2.5 Outs")] if size == 2 else []), key=str)
    many = spark.range(2000).select(F.lit("a").alias("player"), F.concat(F.lit("Over "), F.col("id"), F.lit(".5 Hits")).alias("leg"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = markets.leg_combos(many).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r.n for r in out) == 2000 * 1999 // 2 and len(out) == 8 and max(r.n for r in out) < 600_000


def test_seasons_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1998, 1, "x"), (1999, 2, None)], "season int, a long, b string")
    tables.write_seasons(df, f"{tmp_path}/out")
    back = spark.read.schema(df.schema).json(f"{tmp_path}/out")
    assert {tuple(r) for r in back.select("season", "a", "b").collect()} == {tuple(r) for r in df.collect()}
    both = tables.read_seasons(spark, {1: f"{tmp_path}/out/season=1998", 2: f"{tmp_path}/out/season=1999"}, "a long, b string", "json")
    assert {r.season for r in both.collect()} == {1, 2}
    with pytest.raises(ValueError, match="season 1998"):
        tables.guard_share(df, F.col("a") > 1)
