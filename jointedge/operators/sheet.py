"""Odds sheets: all-string rows to canonical legs, with the first reason for each row that is left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import odds, text


def drift_ok(rows: DataFrame) -> DataFrame:
    """Sheets that keep their schema: under ten rows, or at most a fifth of avg_fv not numeric."""
    bad = F.count_if(text.number(F.col("avg_fv")).isNull())
    return rows.groupBy("sheet_id").agg(F.count("*").alias("n"), bad.alias("bad")).select("sheet_id", "n", "bad", ((F.col("n") < 10) | (F.col("bad") * 5 <= F.col("n"))).alias("ok"))


def keep_sound_sheets(rows: DataFrame) -> DataFrame:
    return rows.join(drift_ok(rows).where("ok").select("sheet_id"), "sheet_id", "left_semi")


# Per kind of sheet its market table, and the reasons for rows without a name, market, leg and line.
KINDS = {
    "pitcher": (text.PITCHER_MARKETS, "no pitcher name", "unknown market", "missing fields", "line not offered"),
    "batter": (text.BATTER_MARKETS, "no batter name", "unknown market", "missing fields", "line not valid"),
    "player": (text.PLAYER_MARKETS, "no player name", "unknown NBA market", "missing direction/line", ""),
}
NO_FAIR_VALUE = "avg_fv not numeric"


def normalised(rows: DataFrame, kind: str = "player") -> DataFrame:
    """Adds player, direction, line, stat, fv, books, disagree, suspicious and reason (null for a good row).

    In pitcher sheets bet_name is read for name, direction and line together, and the explicit fields only where it says
    nothing. In the others the explicit fields come first and bet_name fills direction and line, never the name; batters'
    names are folded. disagree marks rows where both are there and differ. A number of books that is none counts as 0. row_key
    is the text that names the row, row_id its number, if it is one.
    """
    markets, no_name, no_market, no_leg, no_line = KINDS[kind]
    parsed = text.parse_bet_name(F.col("bet_name"))
    explicit = {"player": F.nullif(F.trim("player"), F.lit("")), "direction": text.side(F.col("direction")), "line": text.number(F.col("line"))}
    named = {"player": parsed["name"], "direction": parsed["direction"], "line": parsed["line"]}
    both = [explicit[k].isNotNull() & named[k].isNotNull() & (F.lower(explicit[k].cast("string")) != F.lower(named[k].cast("string"))) for k in explicit]
    if kind == "pitcher":
        read = {k: F.when(named["direction"].isNotNull() & (named[k].isNotNull() if k == "player" else F.lit(True)), named[k]).otherwise(explicit[k]) for k in explicit}
    else:
        read = {k: explicit[k] if k == "player" else F.coalesce(explicit[k], named[k]) for k in explicit}
        both = both[1:]
    if kind == "batter":
        read["player"] = F.nullif(text.fold_ascii(read["player"]), F.lit(""))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    finite = lambda c: F.when(F.abs(text.number(F.col(c))) < float("inf"), text.number(F.col(c)))
    values = [
        F.nullif(F.col("L"), F.lit("")).alias("row_key"), finite("L").alias("row_id"), filled("team").alias("team"), filled("game").alias("game"), filled("market").alias("market"), *(v.alias(k) for k, v in read.items()),
        reduce(lambda a, b: a | b, both).alias("disagree"), text.number(F.col("avg_fv")).alias("fv"), F.coalesce(finite("books_count"), F.lit(0.0)).alias("books"), odds.parse_odds_pair(F.col("avg_odds")).alias("pair"), F.col("avg_odds"),
    ]
    # what is read leaves a generator: filters on the reason cannot be pushed below it, where they would repeat the parsing
    x = rows.select("sheet_id", "idx", F.inline(F.array(F.struct(*values))))
    x = x.withColumn("suspicious", F.coalesce((F.col("fv") == F.col("pair.over")) | (F.col("fv") == F.col("pair.under")), F.lit(False))).drop("pair")
    told = F.struct(text.market_stat(F.col("market"), markets).alias("stat"), text.market_drop(F.col("market"), markets, no_market).alias("drop"))
    x = x.select("*", F.inline(F.array(told)))
    missing = F.col("direction").isNull() | F.col("line").isNull()
    drop = F.coalesce("drop", F.when(F.col("market").isNull(), no_market))
    offered = text.line_offered(F.col("stat"), F.col("line"), markets)
    leg = F.coalesce(drop, F.when(missing, no_leg)) if kind == "player" else F.coalesce(F.when(missing | F.col("market").isNull(), no_leg), drop, F.when(~offered, no_line))
    name = F.when(F.col("player").isNull(), no_name)
    reason = F.coalesce(*((leg, name) if kind == "pitcher" else (name, leg)), F.when(F.col("fv").isNull(), NO_FAIR_VALUE))
    return x.select("*", F.inline(F.array(F.struct(reason.alias("reason"))))).drop("drop")


def first_rows(rows: DataFrame) -> DataFrame:
    """The first row, by idx, of each sheet, player and text of the row id ("7" and "07" are two); rows without one all stay."""
    w = W.partitionBy("sheet_id", "player", "row_key", F.when(F.col("row_key").isNull(), F.col("idx"))).orderBy("idx")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def collapsed(rows: DataFrame, low_row_id_wins: bool = False) -> DataFrame:
    """One whole row per player and leg: the most books, then the highest row id (or the lowest; one that is no number is -1), then the first idx.

    seen is the first idx of the leg, which orders a player's legs.
    """
    leg = W.partitionBy("sheet_id", "player", "stat", "direction", "line")
    row_id = F.coalesce("row_id", F.lit(-1.0))
    w = leg.orderBy(F.col("books").desc(), row_id.asc() if low_row_id_wins else row_id.desc(), "idx")
    return rows.withColumns({"__n": F.row_number().over(w), "seen": F.min("idx").over(leg)}).where("__n = 1").drop("__n")


def props(rows: DataFrame) -> DataFrame:
    """Over and under of the same player, stat and line in one record, with the first team and game that its rows name, and when."""
    of = lambda direction, c: F.max(F.when(F.col("direction") == direction, F.col(c)))
    sides = [of(d, c).alias(f"{d.lower()}_{n}") for d in ("Over", "Under") for c, n in (("fv", "fv"), ("avg_odds", "avg_odds"), ("books", "books_count"), ("row_id", "L"), ("suspicious", "fv_suspicious"))]
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct("seen", c))).alias(f"first_{c}") for c in ("team", "game")]
    return rows.groupBy("sheet_id", "player", "stat", F.col("line").alias("threshold")).agg(*first, *sides)


def players(records: DataFrame) -> DataFrame:
    """Per player the first team and game that any row names, and the sorted array of prop records."""
    keep = [c for c in records.columns if c not in ("sheet_id", "player", "first_team", "first_game", "stat", "threshold")]
    first = [F.min(f"first_{c}")[c].alias(c) for c in ("team", "game")]
    return records.groupBy("sheet_id", "player").agg(*first, F.array_sort(F.collect_list(F.struct("stat", "threshold", *keep))).alias("props"))


def coverage(rows: DataFrame) -> DataFrame:
    """Rows, players and suspicious rows by stat."""
    return rows.groupBy("stat").agg(F.count("*").alias("n"), F.count_distinct("player").alias("players"), F.count_if("suspicious").alias("suspicious"))


def props_per_player(records: DataFrame) -> DataFrame:
    """How many players have how many prop records."""
    n = records.groupBy("sheet_id", "player").agg(F.count("*").alias("props"))
    return n.groupBy("props").agg(F.count("*").alias("players"))


def reasons(rows: DataFrame, column: str = "reason") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
