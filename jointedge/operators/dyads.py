"""Ordered pairs of players in one lineup: dyad statistics, slot-pair baselines and floors.

Lineups are collected per game and team (a handful of rows) and exploded in place, which avoids a self-join's shuffle. All
statistics of the combos are one wide aggregation per (pair, season); seasons are weighted afterwards on one row per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import WORD, Leg, by_season, leg_name, mask_words
from .moments import dot, pearson, phi
from .weights import with_schemes

SUMS = ("n", "n1", "n2", "n11", "x", "y", "xx", "yy", "xy")

# A dyad needs 30 games, or 20 with at least 10 in the current season.
COLD, WARM, WARM_CURRENT = 30, 20, 10


def usable(rows: DataFrame) -> DataFrame:
    """Rows with game, team, player and a slot other than 0."""
    return rows.where("gid is not null and t is not null and p is not null and coalesce(bo, 0) <> 0 and trim(string(gid)) <> '' and trim(t) <> ''")


def player_dyads(rows: DataFrame, stats: list[str], legs: list[Leg] = ()) -> DataFrame:
    """season, t, p1, p2, slot1, slot2 and both players' stats (x_*, y_*) for every ordered pair of different rows of a lineup.

    With ``legs``, also which of them hold for each (x_mask0.., y_mask0..): found once a row, before rows are paired.
    """
    words = mask_words(legs)
    stats = [*stats, *(f"mask{i}" for i in range(len(words)))]
    group = usable(rows).select("*", *words).groupBy("season", "gid", "t").agg(F.collect_list(F.struct("p", "bo", *stats)).alias("rows"))
    one = group.select("season", "gid", "t", "rows", F.posexplode("rows").alias("i", "a"))
    two = one.select("season", "gid", "t", "i", "a", F.posexplode("rows").alias("j", "b")).where("i <> j")
    return two.select("season", "gid", "t", F.col("a.p").alias("p1"), F.col("b.p").alias("p2"), F.col("a.bo").alias("slot1"), F.col("b.bo").alias("slot2"), *(F.col(f"a.{s}").alias(f"x_{s}") for s in stats), *(F.col(f"b.{s}").alias(f"y_{s}") for s in stats))


def slot_sums(rows: DataFrame, stats: list[str]) -> DataFrame:
    """Stats of the rows that share game, team and slot (1 to 9), added up.

    Dealt by lineup, not by slot: the same partitioning serves the pairs that are made of the slots.
    """
    held = usable(rows).where("bo between 1 and 9").repartition("season", "gid", "t")
    return held.groupBy("season", "gid", "t", F.col("bo").alias("p"), F.col("bo")).agg(*(F.sum(s).alias(s) for s in stats))


def slot_dyads(rows: DataFrame, stats: list[str], legs: list[Leg] = ()) -> DataFrame:
    return player_dyads(slot_sums(rows, stats), stats, legs)


def slot_pair_samples(dyads: DataFrame, seasons: list[int]) -> DataFrame:
    """slot1, slot2, games, the team games of each slot pair in the pooled ``seasons``, and those of each season."""
    n = [F.count_if(F.col("season") == s).alias(f"n_{s}") for s in seasons]
    return dyads.where(F.col("season").isin(*seasons)).groupBy("slot1", "slot2").agg(F.count("*").alias("games"), *n)


def slot_samples(sums: DataFrame) -> DataFrame:
    """Per season the team games with two slots or more, and their ordered slot pairs."""
    held = sums.groupBy("season", "gid", "t").agg(F.count("*").alias("k"))
    return held.groupBy("season").agg(F.count_if(F.col("k") >= 2).alias("team_games"), F.sum(F.expr("k * (k - 1)")).alias("dyads"))


def _parts(legs: list[Leg], combos: list[tuple[int, int]]) -> dict[str, str]:
    """The distinct sums that the combos are made of: combos share the sums of their legs and stats.

    In SQL, as hundreds of expressions take seconds to put together column by column.
    """
    hit = lambda side, k: f"(shiftright({side}_mask{k // WORD}, {k % WORD}) & 1)"
    raw = lambda side, s: f"CAST(coalesce({side}_{s}, 0) AS BIGINT)"
    out = {}
    for a, b in combos:
        s, t = legs[a][2], legs[b][2]
        out |= {f"n1_{a}": hit("x", a), f"n2_{b}": hit("y", b), f"n11_{a}_{b}": f"{hit('x', a)} * {hit('y', b)}"}
        out |= {f"x_{s}": raw("x", s), f"y_{t}": raw("y", t), f"xx_{s}": f"{raw('x', s)} * {raw('x', s)}", f"yy_{t}": f"{raw('y', t)} * {raw('y', t)}", f"xy_{s}_{t}": f"{raw('x', s)} * {raw('y', t)}"}
    return out


def combo_aggregates(legs: list[Leg], combos: list[tuple[int, int]]) -> list[Column]:
    """The sums of all combos: a single pass over the dyads, whatever the number of combos."""
    return [F.expr("count(*) AS n"), *(F.expr(f"sum({v}) AS c_{k}") for k, v in _parts(legs, combos).items())]


def long_combos(wide: DataFrame, keys: list[str], legs: list[Leg], combos: list[tuple[int, int]]) -> DataFrame:
    """One row per combo, with its sums from those of its legs and stats."""

    def sums(i: int, a: int, b: int) -> str:
        s, t = legs[a][2], legs[b][2]
        held = {"n1": f"n1_{a}", "n2": f"n2_{b}", "n11": f"n11_{a}_{b}", "x": f"x_{s}", "y": f"y_{t}", "xx": f"xx_{s}", "yy": f"yy_{t}", "xy": f"xy_{s}_{t}"}
        return f"named_struct('idx', {i}, {', '.join(f"'{k}', c_{v}" for k, v in held.items())})"

    return wide.select(*keys, "n", F.expr(f"inline(array({', '.join(sums(i, a, b) for i, (a, b) in enumerate(combos))}))"))


def season_moments(dyads: DataFrame, keys: list[str], legs: list[Leg], combos: list[tuple[int, int]]) -> DataFrame:
    """Sums per key, season and combo."""
    wide = dyads.groupBy(*keys, "season").agg(*combo_aggregates(legs, combos))
    return long_combos(wide, [*keys, "season"], legs, combos)


def passing_moments(dyads: DataFrame, keys: list[str], legs: list[Leg], combos: list[tuple[int, int]], seasons: list[int]) -> DataFrame:
    """``season_moments`` of the keys that have enough games in the pooled ``seasons``, whose last is the current one.

    The games are added up over a key's seasons before the combos are unfolded; what follows by key needs no shuffle.
    """
    wide = dyads.where(F.col("season").isin(*seasons)).groupBy(*keys, "season").agg(*combo_aggregates(legs, combos))
    key = Window.partitionBy(*keys)
    n, now = F.sum("n").over(key), F.sum(F.when(F.col("season") == seasons[-1], F.col("n")).otherwise(0)).over(key)
    held = wide.withColumns({"__all": n, "__now": now}).where(passes(F.col("__all"), F.col("__now"))).drop("__all", "__now")
    return long_combos(held, [*keys, "season"], legs, combos)


def weighted_report(moments: DataFrame, keys: list[str], legs: list[Leg], combos: list[tuple[int, int]], schemes: dict[str, tuple[float, ...]], seasons: list[int]) -> DataFrame:
    """r_binary, r_margin, hit1, hit2, both, neither per scheme, key and combo; scheme weights as they are, neither normalised nor pinned."""
    span = range(len(seasons))
    x = with_schemes(by_season(moments, [*keys, "idx"], list(SUMS), seasons), schemes)
    w = [F.col(f"w{i}") for i in span]
    total = {k: dot([F.col(f"{k}_{i}") for i in span], w) for k in SUMS}
    raw_n = F.coalesce("n_0", F.lit(0))
    for i in list(span)[1:]:
        raw_n = raw_n + F.coalesce(f"n_{i}", F.lit(0))
    first, second = (F.array(*(F.lit(leg_name(legs[c[k]])) for c in combos)) for k in (0, 1))
    x = x.select("scheme", *keys, F.get(first, F.col("idx")).alias("leg1"), F.get(second, F.col("idx")).alias("leg2"), raw_n.alias("games"), *(v.alias(k) for k, v in total.items()))
    c = {k: F.col(k) for k in SUMS}
    rate = lambda v: F.round(F.try_divide(v * 100, c["n"]), 1)
    return x.select(
        "scheme", *keys, "leg1", "leg2", "games", F.round(phi(c["n"], c["n1"], c["n2"], c["n11"]), 4).alias("r_binary"), F.round(pearson(c["n"], c["x"], c["y"], c["xx"], c["yy"], c["xy"]), 4).alias("r_margin"),
        rate(c["n1"]).alias("hit1"), rate(c["n2"]).alias("hit2"), rate(c["n11"]).alias("both"), rate(c["n"] - c["n1"] - c["n2"] + c["n11"]).alias("neither"),
    ).where("coalesce(r_binary, r_margin) is not null")


def passes(n: Column, current: Column) -> Column:
    return F.when(current >= WARM_CURRENT, n >= WARM).otherwise(n >= COLD)


def dyad_meta(dyads: DataFrame, seasons: list[int]) -> DataFrame:
    """Games, slot gaps, adjacency, usual slots and the slot histogram of each dyad that passes the threshold; ties to the smallest value.

    The pooled ``seasons`` count, and the last of them as the current one. Dyads are counted by slots and season once, with map-side sums; everything else is made of these counts.
    """
    keys = ["p1", "p2", "t"]
    counts = dyads.where(F.col("season").isin(*seasons)).groupBy(*keys, "slot1", "slot2").agg(F.count("*").alias("k"), F.count_if(F.col("season") == seasons[-1]).alias("k_cur"))
    gap, k = F.abs(F.col("slot1") - F.col("slot2")), F.col("k")
    slots = F.struct(F.concat_ws("_", "slot1", "slot2").alias("slots"), "slot1", "slot2", gap.alias("gap"), "k")
    base = counts.groupBy(*keys).agg(
        F.sum("k").alias("n_total"), F.sum("k_cur").alias("n_cur"), F.sum(gap * k).alias("gaps"), F.sum(F.when(gap == 1, k).otherwise(0)).alias("adjacent"), F.array_sort(F.collect_list(slots)).alias("held")
    ).where(passes(F.col("n_total"), F.col("n_cur")))

    def usual(field: str) -> Column:
        """The most frequent value of a field, from the counts of its distinct values."""
        times = lambda v: F.aggregate(F.filter("held", lambda h: h[field] == v), F.lit(0).cast("long"), lambda a, h: a + h["k"])
        return F.array_min(F.transform(F.array_distinct(F.col(f"held.{field}")), lambda v: F.struct((-times(v)).alias("k"), v.alias("v"))))["v"]

    top = F.array_min(F.transform("held", lambda h: F.struct((-h["k"]).alias("k"), h["slots"].alias("slots"))))
    usage = F.map_from_entries(F.transform("held", lambda h: F.struct(h["slots"].alias("slots"), h["k"].alias("k"))))
    out = base.withColumn("top", top)
    return out.select(*keys, "n_total", "n_cur", (F.col("gaps") / F.col("n_total")).alias("gap_mean"), usual("gap").alias("gap_mode"), (F.col("adjacent") / F.col("n_total")).alias("adjacency"), usual("slot1").alias("slot1"), usual("slot2").alias("slot2"), usage.alias("slot_usage"), F.col("top.slots").alias("top_slots"), (-F.col("top.k")).alias("top_n"))


def positional(report: DataFrame, keys: list[str], order: dict[tuple[str, str], int]) -> DataFrame:
    """Combo records as an array aligned with the spec: position idx holds [r_binary, r_margin, hit1, hit2, both], gaps are null."""
    spec = report.sparkSession.createDataFrame([(a, b, i) for (a, b), i in order.items()], "leg1 string, leg2 string, idx int")
    values = F.array(*(F.col(k) for k in ("r_binary", "r_margin", "hit1", "hit2", "both")))
    held = report.join(F.broadcast(spec), ["leg1", "leg2"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("idx", values.alias("v")))).alias("m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(len(order) - 1)), lambda i: F.element_at("m", i)).alias("combos"))


def from_positional(packed: DataFrame, keys: list[str], order: dict[tuple[str, str], int]) -> DataFrame:
    """The records of ``positional`` as rows again."""
    spec = packed.sparkSession.createDataFrame([(a, b, i) for (a, b), i in order.items()], "leg1 string, leg2 string, idx int")
    rows = packed.select(*keys, F.posexplode("combos").alias("idx", "v")).where("v is not null").join(F.broadcast(spec), "idx")
    return rows.select(*keys, "leg1", "leg2", *(F.get("v", F.lit(i)).alias(k) for i, k in enumerate(("r_binary", "r_margin", "hit1", "hit2", "both"))))
