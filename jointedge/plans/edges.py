"""Queries that bring statistics, prices and gates together: shrunk correlations, tonight's combos, picks and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import odds, shrink, text
from ..operators import candidates, dyads, entities, slate, uploads
from ..operators.weights import ENTITY_SCHEMES
from ..sources import tables
from ..sources.adapters import ENTITY_LEGS, LINEUP_STATS, SEASONS, adapted
from .queries import _asked, _dyads, _meta, _quotes, _tickets, _uploads, dyad_combos, dyad_lookup, global_pairs, lineups, pooled_pairs, query, slot_baselines, starts

STATIC = ENTITY_SCHEMES["static"]


def _shrunk(spark, sf_dir):
    base = entities.season_blend(global_pairs(spark, sf_dir), ["leg1", "leg2"], "r", STATIC, SEASONS)
    return entities.shrunk_pairs(pooled_pairs(spark, sf_dir).where("scheme = 'static'"), base)


@query
def shrunk_pairs(spark, sf_dir):
    """Entities' correlations drawn toward those of all entities, by their effective games."""
    return _shrunk(spark, sf_dir).select("p", "leg1", "leg2", "n_eff", F.round("base", 9).alias("base"), F.round("r", 9).alias("r"))


@query
def shrunk_triples(spark, sf_dir):
    return entities.shrunk_triples(_shrunk(spark, sf_dir), ENTITY_LEGS).withColumn("r", F.round("r", 9))


@query
def lineup_share(spark, sf_dir):
    return tables.row_share(adapted(spark, sf_dir, "lineups"), tables.in_lineup(F.col("PA"), F.col("bo")))


@query
def slot_samples(spark, sf_dir):
    return dyads.slot_samples(dyads.slot_sums(lineups(spark, sf_dir), LINEUP_STATS))


@query
def slot_pair_samples(spark, sf_dir):
    return dyads.slot_pair_samples(dyads.slot_dyads(lineups(spark, sf_dir), LINEUP_STATS), SEASONS)


@query
def dyad_candidates(spark, sf_dir):
    """All combos of the pairs in this season's lineups, with the dyad's correlation resolved against its slot pair's baseline."""
    found = dyad_lookup(spark, sf_dir).where("n_total is not null")
    out = candidates.resolved_combos(found, dyad_combos(spark, sf_dir).where("scheme = 'static'"), slot_baselines(spark, sf_dir))
    return out.select("p1", "p2", "t", "slot1", "slot2", "leg1", "leg2", "asked", "games", F.round("r", 9).alias("r"), F.round("r_margin", 9).alias("r_margin"), "fallback")


@query
def ticket_picks(spark, sf_dir):
    """Nearest entries that pass the gates: games, p-value, known players, props and exact lines."""
    found = candidates.nearest_entries(_tickets(spark, sf_dir), uploads.entries(_uploads(spark, sf_dir)))
    known = adapted(spark, sf_dir, "sheet").select(F.col("player")).where("trim(player) <> ''").distinct()
    return candidates.gated_entries(found, min_games=25, max_p=0.3, props=["Points", "Assists"], known=known, exact_only=True).select("ticket", "entry_id", "n_games", "p_value")


@query
def filtered_candidates(spark, sf_dir):
    n, decimal = F.col("n"), odds.american_to_decimal(F.col("american"))
    team, game = F.concat(F.lit("T"), (n % 5).cast("string")), F.concat(F.lit("G"), (F.col("candidate_id") % 7).cast("string"))
    x = _quotes(spark, sf_dir).select("candidate_id", "n", "status", team.alias("team"), game.alias("game"), F.when(n % 2 == 0, "full_fv").otherwise("hybrid").alias("kind"), shrink.slot_confidence(n % 25).alias("confidence"), F.round(odds.ev_pct(F.col("pa") * F.col("pb"), decimal), 6).alias("ev_pct"))
    return candidates.result_filter(x, min_ev=5, min_n=20, kinds=["full_fv"], confidences=["high", "medium"], teams=["T0", "T2", "T3"], games=["G1", "G2", "G3", "G6"], confirmed_only=True).select("candidate_id", "n", "team", "game", "confidence", "ev_pct")


@query
def featured_sets(spark, sf_dir):
    """The first six sets of the feed, by correlation factor."""
    decimal, second = odds.american_to_decimal(F.col("american")), odds.american_to_decimal(F.col("other"))
    x = _quotes(spark, sf_dir).select(F.col("candidate_id").alias("feed_pos"), odds.correlation_factor(decimal, odds.independent_decimal(F.array(decimal, second))).alias("factor"))
    return candidates.first_sets(x, 6)


@query
def resolved_modes(spark, sf_dir):
    """One dyad's correlations by each way to resolve them."""
    n, own = F.col("n"), F.col("r")
    base = F.when(n % 3 != 0, F.col("pb") - 0.5)
    columns = []
    for mode in ("player", "global", "blended"):
        r = shrink.resolve_dyad_r(own, base, base.isNotNull(), n, mode)
        m = shrink.resolve_dyad_r(F.col("pa") - 0.5, base / 2, base.isNotNull(), n, mode)
        columns += [F.round(r["r"], 9).alias(f"r_{mode}"), F.round(m["r"], 9).alias(f"margin_{mode}"), F.round(r["weight"], 9).alias(f"weight_{mode}"), r["fallback"].alias(f"fallback_{mode}")]
    return _quotes(spark, sf_dir).select("candidate_id", *columns)


@query
def pooled_weights(spark, sf_dir):
    return entities.pooled_weights(starts(spark, sf_dir), ENTITY_SCHEMES, SEASONS)


@query
def dyad_summary(spark, sf_dir):
    """In how many games both legs of a dyad's combo came in."""
    both = F.floor(F.col("both") / 100 * F.col("games") + 0.5).cast("long")
    return dyad_combos(spark, sf_dir).where("scheme = 'unweighted'").select("p1", "p2", "t", "leg1", "leg2", "games", both.alias("both_games"))


@query
def folded_dyads(spark, sf_dir):
    """Pairs whose names come from elsewhere, in other case and with accents, with their dyads."""
    meta = _meta(spark, sf_dir).select("p1", "p2", "t", "n_total")
    lineup = lineups(spark, sf_dir).where(F.col("season") == SEASONS[-1]).select("gid", "t", F.col("bo").alias("slot"), F.col("p").alias("player")).distinct()
    pairs = slate.lineup_pairs(lineup, ["gid", "t"]).select(F.regexp_replace("p1", "a", "à").alias("p1"), F.upper("p2").alias("p2"), F.lower("t").alias("t"), "slot1", "slot2")
    asked = pairs.groupBy("p1", "p2", "t").agg(F.count("*").alias("asked"))
    return candidates.find_folded(asked, meta).select("p1", "p2", "t", "asked", "swapped", "n_total")


@query
def team_funnel(spark, sf_dir):
    """Why candidates do not go on when only some teams are scanned."""
    team = F.concat(F.lit("T"), (F.col("n") % 5).cast("string"))
    reason = candidates.gate_reason(F.col("n"), F.col("r"), F.col("status"), 30, 0.05, team, ["T1", "T4"])
    return candidates.funnel(_quotes(spark, sf_dir).select(reason.alias("reason")))


@query
def pair_funnel(spark, sf_dir):
    n, decimal = F.col("n"), odds.american_to_decimal(F.col("american"))
    x = _quotes(spark, sf_dir).select("status", F.concat_ws("_", n, F.col("candidate_id") % 7).alias("pair_key"), decimal.alias("decimal"), odds.ev_pct(F.col("pa") * F.col("pb"), decimal).alias("ev_pct"))
    return candidates.pair_funnel(x, F.col("decimal").isNotNull(), candidates.ev_filter(F.col("ev_pct") / 100, 5))


@query
def upload_folded(spark, sf_dir):
    """Uploaded entries under folded names: two spellings of a name are one."""
    good = uploads.entries(_uploads(spark, sf_dir))
    held = uploads.index_by_folded(good.withColumn("player", F.when(F.col("id") % 2 == 0, F.upper("player")).otherwise(F.regexp_replace("player", "o", "ö"))))
    return held.select("key", "names", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@query
def playable_games(spark, sf_dir):
    """Games that count and whose legs can be combined, by day and the day before."""
    games = adapted(spark, sf_dir, "feed").withColumn("tags", F.split("tags", ",")).withColumn("d", text.day_of(F.col("day")))
    held = slate.playable(games)
    return held.groupBy(F.col("d").cast("string").alias("d"), F.date_sub("d", 1).cast("string").alias("eve"), "game_type").agg(F.count("*").alias("n"))


@query
def short_stats(spark, sf_dir):
    legs = text.parse_leg(F.concat_ws(" ", "direction", F.col("thr").cast("string"), "stat"))
    x = _asked(spark, sf_dir).select("leg_id", legs.alias("leg"))
    x = x.withColumn("short", text.short_stat(F.col("leg.stat")))
    return x.select("leg_id", "leg.direction", "leg.threshold", "leg.stat", "short.code", "short.skip")


@query
def slim_starts(spark, sf_dir):
    """Starts under short names; numbers that are none are null."""
    x = tables.renamed(adapted(spark, sf_dir, "starts").withColumn("ip", F.when(F.col("gid") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("ip"))), {"p": "pid", "season": "y", "ip": "i", "ER": "e"})
    held = x.select("pid", "y", tables.clean_number(F.col("i")).alias("i"), tables.clean_number(F.col("e")).alias("e"))
    return held.groupBy("y").agg(F.count("*").alias("n"), F.count("i").alias("n_i"), F.sum("e").alias("e"))
