"""Candidate combinations: look-ups, nearest lines, pricing, funnel, filters and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import joint, odds, shrink, text
from .uploads import pair_key


def bound(df: DataFrame) -> DataFrame:
    """The same rows. The columns leave a generator, so no filter is inferred from how they are made, which can take long to plan."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def find_dyads(pairs: DataFrame, dyads: DataFrame) -> DataFrame:
    """Pairs (p1, p2, t, ...) with their dyad in either order of the names; a dyad stored both ways is taken in the pair's own order.

    ``swapped`` tells that the dyad's players stand the other way round, so its sides have to be exchanged.
    """
    stats = [c for c in dyads.columns if c not in ("p1", "p2", "t")]
    d = dyads.select(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b"), "t", F.col("p1").alias("first"), F.struct(*stats).alias("d"))
    d = d.groupBy("a", "b", "t").agg(F.max_by("d", F.when(F.col("first") == F.col("a"), 1).otherwise(0)).alias("low"), F.max_by("d", F.when(F.col("first") == F.col("a"), 0).otherwise(1)).alias("high"), F.min("first").alias("f0"), F.max("first").alias("f1"))
    x = pairs.withColumn("a", F.least("p1", "p2")).withColumn("b", F.greatest("p1", "p2")).join(d, ["a", "b", "t"], "left")
    own = F.when(F.col("p1") == F.col("a"), F.col("low")).otherwise(F.col("high"))
    swapped = (F.col("f0") == F.col("f1")) & (F.col("f0") != F.col("p1"))
    return x.withColumn("swapped", F.coalesce(swapped, F.lit(False))).withColumn("d", own).select(*pairs.columns, "swapped", *(F.col(f"d.{c}").alias(c) for c in stats))


def find_folded(pairs: DataFrame, dyads: DataFrame) -> DataFrame:
    """``find_dyads`` by folded names of players and team; of dyads that fold alike the one with the least names is taken.

    Distinct names are folded, not rows.
    """
    names = [df.select(F.explode(F.array("p1", "p2", "t")).alias("name")) for df in (pairs, dyads)]
    keys = names[0].union(names[1]).distinct().select("name", text.fold_key(F.col("name")).alias("key"))

    def folded(df: DataFrame) -> DataFrame:
        for c in ("p1", "p2", "t"):
            df = df.join(keys.select(F.col("name").alias(c), F.col("key").alias(f"__{c}")), c, "left")
        return df

    stats = [c for c in dyads.columns if c not in ("p1", "p2", "t")]
    own = folded(dyads).groupBy("__p1", "__p2", "__t").agg(F.min_by(F.struct(*stats), F.struct("p1", "p2", "t")).alias("d"))
    own = own.select(*(F.col(f"__{c}").alias(c) for c in ("p1", "p2", "t")), "d.*")
    asked = folded(pairs)
    met = asked.select(*(F.col(c).alias(f"own_{c}") for c in ("p1", "p2", "t")), *(F.col(f"__{c}").alias(c) for c in ("p1", "p2", "t")), *(c for c in pairs.columns if c not in ("p1", "p2", "t")))
    rest = [c for c in pairs.columns if c not in ("p1", "p2", "t")]
    return find_dyads(met, own).select(*(F.col(f"own_{c}").alias(c) for c in ("p1", "p2", "t")), *rest, "swapped", *stats)


_ASKED = ["player", "prop_1", "side_1", "line_1", "prop_2", "side_2", "line_2"]


def nearest_entries(tickets: DataFrame, entries: DataFrame) -> DataFrame:
    """Per ticket the entry of the same player and leg pair, in either order, with the least distance of lines; ties by more games, then id.

    tickets: ticket, player, prop_1, side_1, line_1, prop_2, side_2, line_2. Hit rates and lines are turned to the ticket's order.
    Only distinct line pairs meet: of the entries with the same legs the best is kept, and equal tickets ask once, so a
    popular player costs line pairs and not rows squared.
    """
    tickets, entries = bound(tickets), bound(entries)
    t = tickets.select(*_ASKED).distinct().withColumn("pair", pair_key(F.col("prop_1"), F.col("side_1"), F.col("prop_2"), F.col("side_2")))
    legs = F.struct(F.col("leg1.prop").alias("prop"), F.col("leg1.side").alias("side"), F.col("leg1.line").alias("line"), F.col("leg2.line").alias("other"))
    e = entries.select(
        "player", pair_key(F.col("leg1.prop"), F.col("leg1.side"), F.col("leg2.prop"), F.col("leg2.side")).alias("pair"), legs.alias("legs"),
        F.struct((-F.col("n_games")).alias("k"), "id", "hit_rate_1", "hit_rate_2", "r_adj", "p_value", "p_joint", "p_independent").alias("e"),
    ).groupBy("player", "pair", "legs").agg(F.min("e").alias("e"))
    x = t.join(e, ["player", "pair"])
    straight = (F.col("legs.prop") == F.col("prop_1")) & (F.col("legs.side") == F.col("side_1"))
    turn = lambda a, b: F.when(straight, F.col(a)).otherwise(F.col(b))
    drift = F.abs(turn("legs.line", "legs.other") - F.col("line_1")) + F.abs(turn("legs.other", "legs.line") - F.col("line_2"))
    rest = [F.col(f"e.{k}").alias(k) for k in ("r_adj", "p_value", "p_joint", "p_independent")]
    found = F.struct(drift.alias("drift"), F.col("e.k").alias("k"), F.col("e.id").alias("id"), turn("e.hit_rate_1", "e.hit_rate_2").alias("h1"), turn("e.hit_rate_2", "e.hit_rate_1").alias("h2"), *rest)
    best = x.groupBy(*(F.col(c).alias(f"__{c}") for c in _ASKED)).agg(F.min(found).alias("m"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _ASKED))
    return tickets.join(best, same, "left").select(
        *tickets.columns, F.col("m.id").alias("entry_id"), F.col("m.drift").alias("drift"), (F.col("m.drift") == 0).alias("exact"), (-F.col("m.k")).alias("n_games"), F.col("m.h1").alias("hit_rate_1"), F.col("m.h2").alias("hit_rate_2"),
        F.col("m.r_adj").alias("r_adj"), F.col("m.p_value").alias("p_value"), F.col("m.p_joint").alias("p_joint"), F.col("m.p_independent").alias("p_independent"),
    )


def gated_entries(found: DataFrame, min_games: int = 0, max_p: float = 1.0, props: list[str] | None = None, known: DataFrame | None = None, exact_only: bool = False) -> DataFrame:
    """The tickets of ``nearest_entries`` that go on. The gates come after the pick: a nearest entry that fails is not replaced.

    A null number of games is zero, a null p-value one. ``props``: both legs must be of these. ``known``: (player) that may pass.
    """
    out = found.where(F.col("entry_id").isNotNull() & (F.coalesce("n_games", F.lit(0)) >= min_games) & (F.coalesce("p_value", F.lit(1.0)) <= max_p))
    if props is not None:
        out = out.where(F.col("prop_1").isin(props) & F.col("prop_2").isin(props))
    if exact_only:
        out = out.where("exact")
    return out if known is None else out.join(known, "player", "left_semi")


def resolved_combos(found: DataFrame, combos: DataFrame, baselines: DataFrame, mode: str = "blended") -> DataFrame:
    """Combos of the dyads that ``find_dyads`` gave pairs (p1, p2, t, slot1, slot2, swapped), in the dyad's own order.

    asked counts the pairs with these players and slots; r and r_margin are the dyad's correlations drawn toward the slot pair's
    as ``mode`` says. Equal pairs are counted first, so a pair that plays often meets its combos once. There are at most 72 slot
    pairs, so the baselines are a small table of 72 rows a combo and are broadcast.
    """
    turn = lambda a, b: F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a))
    asked = found.groupBy(turn("p1", "p2").alias("p1"), turn("p2", "p1").alias("p2"), "t", turn("slot1", "slot2").alias("slot1"), turn("slot2", "slot1").alias("slot2")).agg(F.count("*").alias("asked"))
    own = combos.select("p1", "p2", "t", "leg1", "leg2", "games", F.col("r_binary").alias("own"), F.col("r_margin").alias("own_margin"))
    base = baselines.select("slot1", "slot2", "leg1", "leg2", F.col("r_binary").alias("base"), F.col("r_margin").alias("base_margin"), F.lit(True).alias("known"))
    x = asked.join(own, ["p1", "p2", "t"]).join(F.broadcast(base), ["slot1", "slot2", "leg1", "leg2"], "left")
    res, margin = (shrink.resolve_dyad_r(F.col(f"own{k}"), F.col(f"base{k}"), F.coalesce("known", F.lit(False)), F.col("games"), mode) for k in ("", "_margin"))
    return x.withColumns({"res": res, "margin": margin}).select("p1", "p2", "t", "slot1", "slot2", "leg1", "leg2", "asked", "games", "res.r", F.col("margin.r").alias("r_margin"), "res.fallback")


def fair_values(candidates: DataFrame, props: DataFrame) -> DataFrame:
    """p_leg1, p_leg2 from the sheet (player, stat, threshold, direction, fv), and kind: full_fv, hybrid or corr_only."""
    for i in (1, 2):
        fv = props.select(F.col("player").alias(f"p{i}"), F.col("stat").alias(f"stat{i}"), F.col("threshold").alias(f"threshold{i}"), F.col("direction").alias(f"direction{i}"), odds.american_to_prob(F.col("fv")).alias(f"p_leg{i}"))
        candidates = candidates.join(fv, [f"{k}{i}" for k in ("p", "stat", "threshold", "direction")], "left")
    n = F.col("p_leg1").isNotNull().cast("int") + F.col("p_leg2").isNotNull().cast("int")
    return candidates.withColumn("kind", F.when(n == 2, "full_fv").when(n == 1, "hybrid").otherwise("corr_only"))


def finalised(candidates: DataFrame) -> DataFrame:
    """Missing leg probabilities from two-way prices, joint probability, fair odds, EV and Kelly; candidates whose prices do not do are dropped."""
    fair = lambda s, i: odds.no_vig(F.col(f"{s}_over"), F.col(f"{s}_under"), F.col(f"direction{i}"))

    def priced(v: Column) -> Column:
        joint_p = F.greatest(F.lit(1e-6), F.least(F.lit(0.999999), joint.joint_frechet(v["p1"], v["p2"], v["r"])))
        return F.struct(v["p1"].alias("p1f"), v["p2"].alias("p2f"), joint_p.alias("p_joint"), v["decimal"].alias("decimal"))

    def staked(v: Column) -> Column:
        kelly = odds.full_kelly(v["p_joint"], v["decimal"])
        return F.struct(v["p1f"].alias("p1f"), v["p2f"].alias("p2f"), v["p_joint"].alias("p_joint"), v["decimal"].alias("decimal"), odds.prob_to_american(v["p_joint"]).alias("fair_american"), odds.ev_pct(v["p_joint"], v["decimal"]).alias("ev_pct"), F.when(kelly.isNotNull(), F.greatest(F.lit(0.0), kelly) * 100).alias("kelly_pct"), odds.quarter_kelly_pct(v["p_joint"], v["decimal"]).alias("quarter_kelly_pct"))

    # one-element arrays bind a value once; as plain columns the nested expressions outgrow a generated method
    start = F.array(F.struct(F.coalesce("p_leg1", fair("a", 1)).alias("p1"), F.coalesce("p_leg2", fair("b", 2)).alias("p2"), F.col("r").alias("r"), odds.american_to_decimal(F.col("offered")).alias("decimal")))
    x = candidates.select("*", F.explode(F.transform(F.transform(start, priced), staked)).alias("v"))
    return x.where("v.p1f is not null and v.p2f is not null").select(*candidates.columns, "v.*")


def merged_prices(candidates: DataFrame, prices: DataFrame) -> DataFrame:
    """Prices (candidate_id, matched, offered, decimal, missing) by candidate (fv_joint, model_joint), with EV and edge anew; those without one keep a reason.

    ev_frac is of the joint probability by fair values, edge_points of the model's against the offered price.
    """
    out = candidates.join(prices, "candidate_id", "left")
    decimal = F.when(F.col("matched"), F.col("decimal"))
    implied = F.when(decimal > 0, 1 / decimal)
    out = out.withColumns({"ev_frac": F.col("fv_joint") * decimal - 1, "edge_points": (F.col("model_joint") - implied) * 100})
    return out.withColumn("price_reason", F.when(F.col("matched").isNull(), "not requested").when(~F.col("matched"), F.coalesce(F.array_join("missing", ", "), F.lit("not matched"))))


def matched_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """Each distinct player of ``names`` and whether ``known`` has the folded name."""
    key = text.fold_key(F.col("player"))
    held = known.select("player").distinct().select(key.alias("key")).distinct().withColumn("found", F.lit(True))
    return names.select("player").distinct().withColumn("key", key).join(held, "key", "left").select("player", F.coalesce("found", F.lit(False)).alias("matched"))


def gate_reason(n: Column, r: Column, status: Column, min_n: int, min_abs_r: float, team: Column | None = None, teams: list[str] | None = None) -> Column:
    """Why a candidate does not go on; null if it does. A null r is zero; without ``teams`` all teams do."""
    skipped = F.when(status == "awaiting", "game awaiting")
    if teams:
        skipped = skipped.when(~F.coalesce(team.isin(teams), F.lit(False)), "other team")
    return skipped.when(n.isNull(), "no data").when((n < min_n) | (F.abs(F.coalesce(r, F.lit(0.0))) < min_abs_r), "below threshold")


def funnel(rows: DataFrame) -> DataFrame:
    """considered = all reasons added up."""
    return rows.groupBy(F.coalesce("reason", F.lit("with data")).alias("reason")).agg(F.count("*").alias("n"))


def pair_funnel(rows: DataFrame, priced: Column, surviving: Column) -> DataFrame:
    """Distinct pairs (pair_key) that were emitted, priced and left by the filters, and candidates, by lineup status."""
    pairs = lambda c: F.count_distinct(F.when(c, F.col("pair_key")))
    return rows.groupBy("status").agg(F.count("*").alias("candidates"), F.count_distinct("pair_key").alias("emitted"), pairs(priced).alias("priced"), pairs(priced & surviving).alias("surviving"))


def slate_coverage(lineup: DataFrame) -> DataFrame:
    """Players and possible pairs by team."""
    n = lineup.groupBy("team_id").agg(F.count_distinct("player").alias("players"))
    return n.withColumn("pairs", F.expr("players * (players - 1) div 2"))


def ev_filter(ev_frac: Column, min_pct: float) -> Column:
    """True only for a known EV of at least the minimum."""
    return F.coalesce(ev_frac >= min_pct / 100, F.lit(False))


def result_filter(rows: DataFrame, min_ev: float | None = None, min_n: int = 0, kinds: list[str] | None = None, confidences: list[str] | None = None, teams: list[str] | None = None, games: list[str] | None = None, confirmed_only: bool = False) -> DataFrame:
    """Priced candidates (ev_pct, n, kind, confidence, team, game, status) that a reader asked for; a null EV or n never passes its minimum."""
    keep = F.coalesce(F.col("n"), F.lit(0)) >= min_n
    if min_ev is not None:
        keep = keep & ev_filter(F.col("ev_pct") / 100, min_ev)
    for name, allowed in (("kind", kinds), ("confidence", confidences), ("team", teams), ("game", games)):
        if allowed is not None:
            keep = keep & F.col(name).isin(allowed)
    return rows.where(keep & (F.col("status") == "confirmed") if confirmed_only else keep)


def top_by_r(rows: DataFrame, k: int, id_column: str = "candidate_id") -> DataFrame:
    return rows.orderBy(F.abs(F.coalesce("r", F.lit(0.0))).desc(), id_column).limit(k)


def by_ev(rows: DataFrame, id_column: str = "candidate_id") -> list[Column]:
    """Order: EV down with nulls last, then p-value up (null as 1), then id."""
    return [F.col("ev").desc_nulls_last(), F.coalesce("p_value", F.lit(1.0)).asc(), F.col(id_column).asc()]


def near_tie_order(ev_pct: Column, kind: Column, id_column: str = "candidate_id") -> list[Column]:
    """EV in bands of half a point down, full fair values first inside a band, then EV, then id."""
    return [F.floor(ev_pct / 0.5).desc_nulls_last(), F.when(kind == "full_fv", 0).otherwise(1).asc(), ev_pct.desc_nulls_last(), F.col(id_column).asc()]


def first_sets(rows: DataFrame, k: int = 6) -> DataFrame:
    """The first k sets by feed order, ranked by correlation factor down (null as 0)."""
    return rows.orderBy("feed_pos").limit(k).orderBy(F.coalesce("factor", F.lit(0.0)).desc(), "feed_pos")


def page(rows: DataFrame, order: list[Column], first: int, size: int, cap: int = 60) -> DataFrame:
    """Rows first+1 .. first+size of the order, never beyond ``cap``."""
    return rows.orderBy(*order).limit(min(first + size, cap)).offset(first)
