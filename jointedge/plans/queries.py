"""All queries by name, each on the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import joint, odds, shrink, text
from ..operators import candidates, dyads, entities, markets, sheet, slate, uploads
from ..operators.weights import DYAD_SCHEMES, ENTITY_SCHEMES
from ..sources import tables
from ..sources.adapters import CURRENT, ENTITY_LEGS, EVERY_SEASON, LINEUP_COMBOS, LINEUP_LEGS, LINEUP_STATS, SEASONS, STATS, adapted
from ..streaming import refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The starters' rows of all seasons; outs come from the X.Y innings, as a feed has them."""
    return _starters(adapted(spark, sf_dir, "starts"))


def _starters(rows: DataFrame) -> DataFrame:
    return rows.where(tables.is_starter(F.col("flag"), F.col("ip"))).withColumn("OUTS", text.ip_to_outs(F.col("ip")))


def lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all seasons that were in the lineup and came to bat; stats that are no numbers are zero, HRR is a composite."""
    return _in_lineup(adapted(spark, sf_dir, "lineups"))


def _in_lineup(rows: DataFrame) -> DataFrame:
    x = rows.where(tables.in_lineup(F.col("PA"), F.col("bo")))
    x = x.withColumns({s: tables.zero_int(F.col(s)) for s in LINEUP_STATS if s != "HRR"})
    return x.withColumn("HRR", text.hits_runs_rbis(F.col("H"), F.col("R"), F.col("RBI")))


def _pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.pair_counts(entities.masks(starts(spark, sf_dir), ENTITY_LEGS), entities.combos_of(ENTITY_LEGS, 2))


def _starts_gate() -> tables.Gate:
    return tables.Gate(EVERY_SEASON, tables.is_starter(F.col("flag"), F.col("ip")), F.coalesce(F.col("ip") > 0, F.lit(False)), *tables.STARTER_SHARE)


def _published(spark: SparkSession, name: str, build: DataFrame, gate: tables.Gate) -> DataFrame:
    """A build's rows as they were published, which they are only if its gate holds; the gate is measured while the build reads."""
    store = tables.Snapshots(spark, _shared(spark, name))
    store.publish(build, (gate,))
    return store.current(build.schema)


@query
def season_manifest(spark, sf_dir):
    """Of a build whose every season has a plausible share of starters."""
    gate = _starts_gate()
    build = tables.manifest(_starters(gate.watch(adapted(spark, sf_dir, "starts")))).select("season", "rows", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))
    return _published(spark, "manifest", build, gate)


@query
def entity_build(spark, sf_dir):
    """Entity means, published only if every season's share of starters is plausible."""
    gate = _starts_gate()
    return _published(spark, "entity_build", entities.entity_means(_starters(gate.watch(adapted(spark, sf_dir, "starts"))), STATS), gate)


@query
def starter_share(spark, sf_dir):
    rows = adapted(spark, sf_dir, "starts")
    return tables.row_share(rows, tables.is_starter(F.col("flag"), F.col("ip")), F.col("ip") > 0)


@query
def corpus_summary(spark, sf_dir):
    gate = tables.Gate(EVERY_SEASON, tables.in_lineup(F.col("PA"), F.col("bo")), None, *tables.LINEUP_SHARE)
    return _published(spark, "corpus_summary", tables.corpus_summary(_in_lineup(gate.watch(adapted(spark, sf_dir, "lineups")))), gate)


@query
def entity_means(spark, sf_dir):
    return entities.entity_means(starts(spark, sf_dir), STATS)


@query
def raw_correlations(spark, sf_dir):
    return entities.raw_sums(starts(spark, sf_dir), STATS).select("season", "p", "s1", "s2", "n", entities.raw_r().alias("r"))


@query
def entity_pairs(spark, sf_dir):
    return entities.pair_report(starts(spark, sf_dir), ENTITY_LEGS, entities.combos_of(ENTITY_LEGS, 2), STATS)


@query
def entity_triples(spark, sf_dir):
    counts = entities.triple_counts(entities.masks(starts(spark, sf_dir), ENTITY_LEGS), entities.combos_of(ENTITY_LEGS, 3))
    return entities.triple_report(counts, ENTITY_LEGS)


@query
def global_pairs(spark, sf_dir):
    return entities.global_pairs(_pair_counts(spark, sf_dir), ENTITY_LEGS)


@query
def pooled_pairs(spark, sf_dir):
    return entities.pooled_pairs(_pair_counts(spark, sf_dir), ENTITY_LEGS, ENTITY_SCHEMES, SEASONS)


@query
def entity_seasons(spark, sf_dir):
    x = entities.entity_seasons(starts(spark, sf_dir), SEASONS)
    n = F.element_at("starts_by_year", CURRENT)
    return x.select("p", *(F.element_at("starts_by_year", s).alias(f"n_{s}") for s in SEASONS), F.size("years").alias("n_years"), shrink.entity_scheme(n).alias("bucket"))


def _slot_moments(spark, sf_dir, keys):
    return dyads.season_moments(dyads.slot_dyads(lineups(spark, sf_dir), LINEUP_STATS, LINEUP_LEGS), keys, LINEUP_LEGS, LINEUP_COMBOS)


@query
def slot_baselines(spark, sf_dir):
    static = {"static": DYAD_SCHEMES["static"]}
    return dyads.weighted_report(_slot_moments(spark, sf_dir, ["slot1", "slot2"]), ["slot1", "slot2"], LINEUP_LEGS, LINEUP_COMBOS, static, SEASONS).drop("scheme")


@query
def combo_floors(spark, sf_dir):
    """All slot pairs together: the sums of the slot-pair moments, not of the rows again."""
    pooled = _slot_moments(spark, sf_dir, ["slot1", "slot2"]).groupBy(F.lit("all").alias("pool"), "season", "idx").agg(*(F.sum(k).alias(k) for k in dyads.SUMS))
    return dyads.weighted_report(pooled, ["pool"], LINEUP_LEGS, LINEUP_COMBOS, {"static": DYAD_SCHEMES["static"]}, SEASONS).drop("scheme")


def _dyads(spark, sf_dir):
    return dyads.player_dyads(lineups(spark, sf_dir), LINEUP_STATS, LINEUP_LEGS)


@query
def dyad_combos(spark, sf_dir):
    keys = ["p1", "p2", "t"]
    moments = dyads.passing_moments(_dyads(spark, sf_dir), keys, LINEUP_LEGS, LINEUP_COMBOS, SEASONS)
    return dyads.weighted_report(moments, keys, LINEUP_LEGS, LINEUP_COMBOS, DYAD_SCHEMES, SEASONS)


def _meta(spark, sf_dir):
    return dyads.dyad_meta(_dyads(spark, sf_dir), SEASONS)


@query
def dyad_meta(spark, sf_dir):
    return _meta(spark, sf_dir).withColumn("slot_usage", F.size("slot_usage")).withColumn("bucket", shrink.dyad_scheme(F.col("n_cur")))


@query
def dyad_lookup(spark, sf_dir):
    """The pairs of all lineups of the current season with their dyads in the pair's order."""
    lineup = lineups(spark, sf_dir).where(F.col("season") == CURRENT).select("gid", "t", F.col("bo").alias("slot"), F.col("p").alias("player"))
    pairs = slate.lineup_pairs(lineup.dropDuplicates(), ["gid", "t"])
    found = candidates.find_dyads(pairs, _meta(spark, sf_dir).select("p1", "p2", "t", "n_total", "slot1", "slot2", "slot_usage").withColumnsRenamed({"slot1": "was1", "slot2": "was2"}))
    n = F.coalesce(F.element_at("slot_usage", F.concat_ws("_", "slot1", "slot2")), F.lit(0))
    return found.select("gid", "t", "p1", "p2", "slot1", "slot2", "swapped", "n_total", n.alias("n_here"), shrink.slot_confidence(n).alias("confidence"), shrink.slot_shift(F.col("slot1"), F.col("slot2"), F.col("was1"), F.col("was2")).alias("shift"))


def _quotes(spark, sf_dir):
    return adapted(spark, sf_dir, "quotes")


@query
def odds_scalars(spark, sf_dir):
    a, d = F.col("american"), odds.american_to_decimal(F.col("american"))
    x = _quotes(spark, sf_dir).withColumn("prob", odds.american_to_prob(a)).withColumn("decimal", d)
    return x.select(
        "candidate_id", "prob", "decimal", odds.prob_to_american(F.col("pa")).alias("fair"), odds.decimal_to_american(F.col("decimal")).alias("back"), odds.no_vig(a, F.col("other"), F.col("direction1")).alias("novig"),
        odds.ev_pct(F.col("pa") * F.col("pb"), F.col("decimal")).alias("ev"), odds.quarter_kelly_pct(F.col("pa"), F.col("decimal")).alias("qk"), odds.edge_points(F.col("pa"), F.col("decimal")).alias("edge"),
        odds.independent_decimal(F.array(F.col("decimal"), F.lit(2.0), F.lit(None).cast("double"), F.lit(0.0))).alias("indep"),
    )


@query
def joint_scalars(spark, sf_dir):
    pa, pb, r = F.col("pa"), F.col("pb"), F.col("r")
    x = _quotes(spark, sf_dir).withColumn("j", joint.joint_frechet(pa, pb, r)).withColumn("decimal", odds.american_to_decimal(F.col("american")))
    x = x.withColumn("inv", joint.inverse_joint_frechet(pa, pb, F.col("j"))).withColumn("att", joint.ev_attribution(pa, pb, r, F.col("decimal"))).withColumn("phi", joint.joint_from_phi(r, pa, pb))
    legs = joint.joint_of_legs(F.array(pa, pb), F.array(F.col("phi")), F.array(pa * pb))
    return x.select("candidate_id", "j", F.round("inv.r", 9).alias("r_back"), "inv.clamp", F.round("att.total", 9).alias("total"), F.round("att.from_legs", 9).alias("from_legs"), F.round("att.from_corr", 9).alias("from_corr"), F.round("att.r_gap", 9).alias("r_gap"), F.col("att.clamp").alias("offer_clamp"), F.round("phi", 9).alias("phi"), F.round(legs, 9).alias("legs"))


@query
def verdict_scalars(spark, sf_dir):
    pa, pb, r, n = F.col("pa"), F.col("pb"), F.col("r"), F.col("n")
    x = _quotes(spark, sf_dir).withColumn("att", joint.ev_attribution(pa, pb, r, odds.american_to_decimal(F.col("american"))))
    ev, gap = F.round("att.total", 9), F.round("att.r_gap", 9)
    base = F.when(n % 3 != 0, pb - 0.5)
    res = shrink.resolve_dyad_r(r, base, base.isNotNull(), n)
    return x.select(
        "candidate_id", F.round(res["r"], 9).alias("r_blend"), res["fallback"].alias("fallback"), F.round(shrink.shrunk_entity_r(r, base, n.cast("double")), 9).alias("r_entity"), F.round(shrink.mean_of(r, base, F.lit(None).cast("double")), 9).alias("r_mean"),
        shrink.thesis(ev, F.round("att.from_legs", 9), F.round("att.from_corr", 9)).alias("thesis"), shrink.gap_label(gap).alias("gap"), shrink.pair_verdict(ev, n, gap, F.col("att.clamp")).alias("verdict"),
        shrink.dyad_verdict(ev, shrink.slot_confidence(n)).alias("dyad_verdict"), F.concat_ws(",", shrink.badges(pa, n, ev / 100, pa, pb, n % 2)).alias("badges"),
    )


@query
def candidate_pricing(spark, sf_dir):
    """Hybrid and price-only candidates filled from two-way prices, then EV, filters and the full ranking."""
    x = _quotes(spark, sf_dir).select(
        "candidate_id", F.when(F.col("candidate_id") % 3 != 0, F.col("pa")).alias("p_leg1"), F.when(F.col("candidate_id") % 4 != 0, F.col("pb")).alias("p_leg2"), "direction1", "direction2", "r",
        F.col("american").alias("a_over"), F.col("other").alias("a_under"), F.col("other").alias("b_over"), F.col("american").alias("b_under"), F.col("american").alias("offered"), "n", "status",
    )
    x = candidates.finalised(x).withColumn("reason", candidates.gate_reason(F.col("n"), F.col("r"), F.col("status"), 30, 0.05))
    good = x.where(F.col("reason").isNull() & candidates.ev_filter(F.col("ev_pct") / 100, 3))
    return good.select("candidate_id", F.round("p_joint", 9).alias("p_joint"), "fair_american", F.round("ev_pct", 6).alias("ev_pct"), F.round("kelly_pct", 6).alias("kelly_pct"), F.round("quarter_kelly_pct", 6).alias("quarter_kelly_pct"))


@query
def candidate_funnel(spark, sf_dir):
    x = _quotes(spark, sf_dir)
    return candidates.funnel(x.select(candidates.gate_reason(F.col("n"), F.col("r"), F.col("status"), 30, 0.05).alias("reason")))


@query
def top_candidates(spark, sf_dir):
    """The 60 strongest correlations, then by EV bands with full fair values first."""
    x = _quotes(spark, sf_dir).withColumn("ev", F.round(odds.ev_pct(joint.joint_frechet(F.col("pa"), F.col("pb"), F.col("r")), odds.american_to_decimal(F.col("american"))), 6)).withColumn("kind", F.when(F.col("n") % 2 == 0, "full_fv").otherwise("hybrid"))
    top = candidates.top_by_r(x, 60)
    return candidates.page(top, candidates.near_tie_order(F.col("ev"), F.col("kind")), 0, 30).select("candidate_id", "r", "ev", "kind")


def _sheet(spark, sf_dir, kind="player"):
    name = {"player": "sheet"}.get(kind, f"{kind}_sheet")
    return sheet.normalised(sheet.keep_sound_sheets(adapted(spark, sf_dir, name)), kind)


def _legs_of_sheet(spark, sf_dir, kind="player"):
    """The canonical legs of a sheet; of a pitcher's equal legs the lowest row wins a tie."""
    return sheet.collapsed(sheet.first_rows(_sheet(spark, sf_dir, kind).where("reason is null")), low_row_id_wins=kind == "pitcher")


@query
def sheet_drift(spark, sf_dir):
    return sheet.drift_ok(adapted(spark, sf_dir, "sheet"))


_ROW = ("idx", "player", "team", "game", "direction", "line", "stat", "fv", "books", "disagree", "suspicious", "reason")


@query
def sheet_rows(spark, sf_dir):
    return _sheet(spark, sf_dir).select(*_ROW)


@query
def batter_rows(spark, sf_dir):
    return _sheet(spark, sf_dir, "batter").select(*_ROW)


@query
def pitcher_rows(spark, sf_dir):
    return _sheet(spark, sf_dir, "pitcher").select(*_ROW)


@query
def pitcher_legs(spark, sf_dir):
    return _legs_of_sheet(spark, sf_dir, "pitcher").select("sheet_id", "player", "direction", "line", "stat", "fv", "suspicious")


@query
def sheet_reasons(spark, sf_dir):
    return sheet.reasons(_sheet(spark, sf_dir))


@query
def sheet_props(spark, sf_dir):
    return sheet.props(_legs_of_sheet(spark, sf_dir)).select("sheet_id", "player", "stat", "threshold", "over_fv", "under_fv", "over_books_count", "under_books_count", "over_L", "under_L", "over_fv_suspicious", "under_fv_suspicious")


def _told(players):
    props = F.array_join(F.transform("props", lambda p: F.concat_ws("@", p["stat"], p["threshold"].cast("string"))), ";")
    return players.select("sheet_id", "player", "team", "game", F.size("props").alias("n"), props.alias("props"))


@query
def sheet_players(spark, sf_dir):
    return _told(sheet.players(sheet.props(_legs_of_sheet(spark, sf_dir))))


@query
def batter_players(spark, sf_dir):
    return _told(sheet.players(sheet.props(_legs_of_sheet(spark, sf_dir, "batter"))))


@query
def props_per_player(spark, sf_dir):
    return sheet.props_per_player(sheet.props(_legs_of_sheet(spark, sf_dir)))


@query
def sheet_coverage(spark, sf_dir):
    return sheet.coverage(_sheet(spark, sf_dir).where("reason is null"))


def _uploads(spark, sf_dir):
    return uploads.validated(adapted(spark, sf_dir, "uploads"))


@query
def upload_rejects(spark, sf_dir):
    return uploads.reject_counts(_uploads(spark, sf_dir))


@query
def upload_index(spark, sf_dir):
    return uploads.index_by_pair(uploads.entries(_uploads(spark, sf_dir))).select("player", "pair", F.size("ids").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def _tickets(spark, sf_dir):
    x = adapted(spark, sf_dir, "uploads")
    return x.select(F.col("id").alias("ticket"), F.col("Player_1").alias("player"), F.col("Prop_2").alias("prop_1"), text.side(F.col("Side_2")).alias("side_1"), (F.col("id") % 6 + 0.5).cast("double").alias("line_1"), F.col("Prop_1").alias("prop_2"), text.side(F.col("Side_1")).alias("side_2"), (F.col("id") % 4 + 0.5).cast("double").alias("line_2"))


@query
def nearest_lines(spark, sf_dir):
    return candidates.nearest_entries(_tickets(spark, sf_dir), uploads.entries(_uploads(spark, sf_dir))).select("ticket", "entry_id", "drift", "exact", "n_games", "hit_rate_1", "hit_rate_2")


def _selections(spark, sf_dir):
    return adapted(spark, sf_dir, "selections").withColumn("points", F.col("pts").cast("double"))


def _asked(spark, sf_dir):
    return adapted(spark, sf_dir, "legs").withColumn("threshold", F.col("thr").cast("double"))


@query
def leg_matches(spark, sf_dir):
    return markets.match_legs(_asked(spark, sf_dir), _selections(spark, sf_dir)).select("leg_id", "selectionId")


@query
def batter_leg_matches(spark, sf_dir):
    return markets.match_legs(_asked(spark, sf_dir), _selections(spark, sf_dir), "batter", prefer_two_way=True).select("leg_id", "selectionId")


@query
def exact_leg_matches(spark, sf_dir):
    return markets.match_legs(_asked(spark, sf_dir), _selections(spark, sf_dir), "player", half_points=False).select("leg_id", "selectionId")


def _priced(found: DataFrame) -> DataFrame:
    return found.select("leg_id", "selectionId", "opposite_id", *(odds.parse_american(F.col(c)).alias(c) for c in ("over_odds", "under_odds")))


@query
def batter_sides(spark, sf_dir):
    """Matched legs of batters with both sides' odds: the other side by the rules for name and stat, at the same points and subcategory."""
    return _priced(markets.leg_sides(_asked(spark, sf_dir), _selections(spark, sf_dir), "batter", prefer_two_way=True))


@query
def player_sides(spark, sf_dir):
    return _priced(markets.leg_sides(_asked(spark, sf_dir), _selections(spark, sf_dir), "player", half_points=False))


@query
def opposite_odds(spark, sf_dir):
    x = _selections(spark, sf_dir).withColumn("stat", F.col("marketName"))
    out = markets.opposite_sides(x)
    return out.select("selectionId", odds.parse_american(F.col("over_odds")).alias("over_odds"), odds.parse_american(F.col("under_odds")).alias("under_odds"))


@query
def market_classes(spark, sf_dir):
    classes = [f"{a}_{k}" for a in ("is", "keeps") for k in ("pitcher", "batter", "player")]
    return markets.classified(_selections(spark, sf_dir)).groupBy("marketName", "subcategory", *classes).agg(F.count("*").alias("n"))


@query
def starters(spark, sf_dir):
    return slate.starters(adapted(spark, sf_dir, "box")).groupBy("gid", "team_id").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.sum("player").alias("players"))


@query
def look_back(spark, sf_dir):
    games = adapted(spark, sf_dir, "games")
    return slate.last_final(games.select("team_id", "d").distinct(), games).select("team_id", F.col("d").cast("string").alias("d"), "gid", F.col("past").cast("string").alias("past"))


@query
def slate_coverage(spark, sf_dir):
    return candidates.slate_coverage(adapted(spark, sf_dir, "box").select("team_id", "player"))


@query
def folded_names(spark, sf_dir):
    """Words of whole documents, folded and counted: words are counted first, so that each distinct one is folded once."""
    x = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return x.groupBy(text.fold_key(F.col("name")).alias("key")).agg(F.sum("n").alias("n"))


def _shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; without one, in the warehouse of a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a stream takes a folder or a pattern and the table may be one file
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_moments(spark, sf_dir):
    path = _shared(spark, "moments")
    rows = _events(spark, sf_dir).select("ts", F.col("event_id").alias("gid"), F.col("user_id").alias("p"), F.year("ts").alias("season"), F.when(F.col("value") > 20, 1).otherwise(0).alias("h1"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("h2"))
    refresh.keep_moments(refresh.new_rows(rows), f"{path}/batches", f"{path}/checkpoint").awaitTermination()
    return refresh.compacted(spark, f"{path}/batches", f"{path}/totals")


@query
def stream_requests(spark, sf_dir):
    """Requests per fingerprint and ten minutes. Windows are written once, when the watermark has passed them, and their state is dropped."""
    path = _shared(spark, "requests")
    stream = _events(spark, sf_dir).select("ts", F.concat_ws(":", "user_id", "event_type").alias("fingerprint"))
    refresh.keep_windows(refresh.requests_per_window(stream), f"{path}/counts", f"{path}/checkpoint").awaitTermination()
    closed = spark.read.schema("start timestamp, fingerprint string, n long").parquet(f"{path}/counts")
    return closed.select(F.col("start").cast("string").alias("start"), "fingerprint", "n")


@query
def stream_fresh(spark, sf_dir):
    """Each fingerprint's first request; repeats within its life of 40 days, longer than the feed, are dropped."""
    path = _shared(spark, "fresh")
    stream = _events(spark, sf_dir).select("ts", F.concat_ws(":", "user_id", "event_type").alias("fingerprint"))
    refresh.keep_windows(refresh.fresh_requests(stream, "40 days").select("fingerprint"), f"{path}/kept", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("fingerprint string").parquet(f"{path}/kept")


@query
def stream_reuse(spark, sf_dir):
    """Each request of an event type and user group, and whether a success of the ten minutes before answers it; every seventh request fails."""
    path = _shared(spark, "reuse")
    conf, held = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        fingerprint = F.concat_ws(":", "event_type", (F.col("user_id") % 10).cast("string"))
        stream = _events(spark, sf_dir).select(F.col("event_id").alias("request_id"), "ts", fingerprint.alias("fingerprint"), (F.col("event_id") % 7 != 0).alias("ok"))
        refresh.keep_windows(refresh.reused_requests(stream), f"{path}/answers", f"{path}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(conf, held)
    return spark.read.schema("request_id long, fingerprint string, cached boolean, age_s long").parquet(f"{path}/answers")


@query
def season_refresh(spark, sf_dir):
    """Pair moments of all seasons, kept by season: built from the past ones, then refreshed with the current, which reads and writes that one alone."""
    kept = refresh.SeasonMoments(spark, _shared(spark, "season_moments"))
    rows = starts(spark, sf_dir).select("season", "p", F.when(F.col("K") > 24.5, 1).otherwise(0).alias("h1"), F.when(F.col("ER") > 4.5, 1).otherwise(0).alias("h2"))
    kept.apply(rows.where(F.col("season") != CURRENT), 0)
    kept.apply(rows.where(F.col("season") == CURRENT), 1)
    return kept.read()
