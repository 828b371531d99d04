"""Lineup slates: decoding, starters, look-back to the last final game, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import slot_of_order

STARTERS = 9


def starters(box: DataFrame) -> DataFrame:
    """gid, team_id, slot, player: the first nine by slot of rows (gid, team_id, ord, player); substitutes (ord % 100 not 0) drop out."""
    x = box.where("ord % 100 = 0 and ord > 0").withColumn("slot", slot_of_order(F.col("ord")))
    w = W.partitionBy("gid", "team_id").orderBy("slot", "player")
    return x.withColumn("k", F.row_number().over(w)).where(F.col("k") <= STARTERS).select("gid", "team_id", "slot", "player")


def last_final(wanted: DataFrame, games: DataFrame, days: int = 3) -> DataFrame:
    """For (team_id, d) the latest Final game of the team in the ``days`` before d; ties to the larger gid."""
    past = games.where("state = 'Final'").groupBy("team_id", F.col("d").alias("past")).agg(F.max("gid").alias("gid"))
    asked = wanted.select("team_id", "d", F.explode(F.array(*(F.date_sub("d", i) for i in range(1, days + 1)))).alias("past"))
    hit = asked.join(past, ["team_id", "past"])
    return hit.groupBy("team_id", "d").agg(F.max(F.struct("past", "gid")).alias("g")).select("team_id", "d", F.col("g.gid").alias("gid"), F.col("g.past").alias("past"))


def side_status(n: Column, looked_back: Column) -> Column:
    """confirmed with nine, projected if the look-back filled the side, else awaiting."""
    return F.when(n >= STARTERS, "confirmed").when(F.coalesce(looked_back, F.lit(0)) >= STARTERS, "projected").otherwise("awaiting")


def game_status(home: Column, away: Column) -> Column:
    both = F.array(home, away)
    return F.when(F.array_contains(both, "awaiting"), "awaiting").when(F.array_contains(both, "projected"), "projected").otherwise("confirmed")


def backfilled(rows: DataFrame, people: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null attributes from the person table."""
    known = people.select(key, *(F.col(c).alias(f"__{c}") for c in columns)).dropDuplicates([key])
    out = rows.join(known, key, "left")
    return out.select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


# Game types that are no championship games, and the tag of events whose legs can be combined.
PRACTICE, COMBINED = ("S", "E"), "SGP"


def playable(games: DataFrame) -> DataFrame:
    """Games (game_type, tags: an array) that count and whose legs can be combined; an unknown type counts, no tags do not."""
    return games.where(~F.coalesce(F.col("game_type").isin(*PRACTICE), F.lit(False)) & F.coalesce(F.array_contains("tags", COMBINED), F.lit(False)))


def flattened(slates: DataFrame) -> DataFrame:
    """One row per player of nested slates (game_id, home_lineup, away_lineup: arrays of structs)."""
    one = lambda side: slates.select("game_id", F.lit(side).alias("side"), F.posexplode_outer(f"{side}_lineup").alias("pos", "e")).select("game_id", "side", "pos", "e.*")
    return one("home").unionByName(one("away"))


def lineup_pairs(lineup: DataFrame, keys: list[str]) -> DataFrame:
    """Unordered pairs of a side's players, by slot then player."""
    held = lineup.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "player"))).alias("l"))
    out = held.select(*keys, "l", F.posexplode("l").alias("i", "a")).select("*", F.posexplode("l").alias("j", "b")).where("i < j")
    return out.select(*keys, F.col("a.player").alias("p1"), F.col("b.player").alias("p2"), F.col("a.slot").alias("slot1"), F.col("b.slot").alias("slot2"))
