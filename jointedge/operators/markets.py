"""Market feeds: classification, and matching of legs, sides, teams and games to selections. First match means feed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def _text(*columns: str) -> Column:
    return F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns))


def classified(markets: DataFrame) -> DataFrame:
    """Adds is_pitcher, is_batter, is_player (by the words of name, type and subcategory; a player prop is neither of the others),
    and keeps_pitcher, keeps_batter, keeps_player: whether its subcategory is read for that class."""
    out = markets.withColumns({f"is_{k}": text.of_class(_text("marketName", "marketType", "subcategory"), words) for k, words in text.PROP_WORDS.items()})
    out = out.withColumn("is_player", F.col("is_player") & ~F.col("is_pitcher") & ~F.col("is_batter"))
    return out.withColumns({f"keeps_{k}": text.of_class(F.col("subcategory"), words) for k, words in text.SHELF_WORDS.items()})


FEED = "eventId string, markets array<struct<marketId: string, marketName: string, subcategory: string, marketType: string, selections: array<struct<feed_pos: long, selectionId: string, outcomeType: string, points: double>>>>"


def flattened_feed(feed: DataFrame) -> DataFrame:
    """One row per selection of a nested market feed (``FEED``); markets without selections have none."""
    one = feed.select("eventId", F.explode("markets").alias("m")).select("eventId", "m.*")
    return one.select("eventId", "marketId", "marketName", "subcategory", "marketType", F.explode("selections").alias("s")).select("eventId", "marketId", "marketName", "subcategory", "marketType", "s.*")


def with_selections(markets: DataFrame, selections: DataFrame) -> DataFrame:
    """Selections of the markets that an event lists."""
    return selections.join(markets, "marketId")


def _first(matches: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Per key the columns of the first match; a min of structs, so matches are reduced before the shuffle."""
    ranked = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *keep)
    return matches.groupBy(*keys).agg(F.min(ranked).alias("m")).select(*keys, *(F.col(f"m.{k}").alias(k) for k in keep))


_LEG = ["player", "direction", "threshold", "stat"]


def name_blocks(plain: Column) -> Column:
    """The keys under which two names that ``names_match`` accepts meet: last word with first letter, and last word alone if it has over three letters.

    Nameless rows have none, so they meet nobody.
    """
    last = text.last_token(plain)
    both = F.when(plain != "", F.concat_ws(" ", F.substring(plain, 1, 1), last))
    return F.array_compact(F.array(both, F.when(F.length(last) > 3, last)))


def _offers(props: DataFrame, kind: str) -> DataFrame:
    """Distinct offers of a class by player (pb), direction, points, market text and subcategory, each with its first selection, under their name blocks."""
    price = F.col("oddsAmerican") if "oddsAmerican" in props.columns else F.lit(None).cast("string")
    b = classified(props).where(f"is_{kind}").select(
        text.plain_name(F.col("player")).alias("pb"), text.selection_direction(F.col("outcomeType")).alias("direction"), "points", "feed_pos", "selectionId", price.alias("price"), _text("marketName", "subcategory", "marketType").alias("blob"), F.coalesce("subcategory", F.lit("")).alias("shelf")
    )
    b = b.groupBy("pb", "direction", "points", "blob", "shelf").agg(F.min(F.struct("feed_pos", "selectionId", "price", "points", "shelf")).alias("offer"))
    return b.withColumn("ou", F.lower("shelf").contains("o/u")).withColumn("block", F.explode(name_blocks(F.col("pb"))))


def _speaks(kind: str) -> Column:
    """Whether an offer is of a leg's player and stat."""
    return text.names_match(F.col("pa"), F.col("pb")) & text.stat_in_blob(F.col("stat"), F.col("blob"), text.STATS_OF[kind])


def _best_offers(legs: DataFrame, offers: DataFrame, kind: str, half_points: bool, prefer_two_way: bool) -> DataFrame:
    """Distinct legs that an offer matches, with the first."""
    a = legs.select(*_LEG).distinct().withColumn("pa", text.plain_name(F.col("player")))
    half = F.when(F.col("direction") == "Over", 0.5).otherwise(-0.5)
    accepted = F.array(F.lit(0.0), half) if half_points else F.array(F.lit(0.0))
    a = a.select("*", F.explode(F.array_distinct(F.transform(accepted, lambda d: F.col("threshold") + d))).alias("points")).withColumn("block", F.explode(name_blocks(F.col("pa"))))
    hit = a.join(offers, ["block", "direction", "points"]).where(_speaks(kind))
    rank = F.struct(F.when(F.col("ou"), 0).otherwise(1).alias("two_way"), "offer") if prefer_two_way else F.struct("offer")
    return hit.groupBy(*_LEG).agg(F.min(rank).alias("m")).select(*_LEG, "m.offer")


def _for_legs(legs: DataFrame, found: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``legs`` with values of what was found for each distinct leg; null where nothing was."""
    named = found.select(*(F.col(c).alias(f"__{c}") for c in _LEG), *(v.alias(k) for k, v in values.items()))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _LEG))
    return legs.join(named, same, "left").select(*legs.columns, *values)


def match_legs(legs: DataFrame, props: DataFrame, kind: str = "pitcher", half_points: bool = True, prefer_two_way: bool = False) -> DataFrame:
    """For each leg (leg_id, player, direction, threshold, stat) the first selection of its class that offers it; null selectionId where none does.

    ``kind``: pitcher, batter or player, for the class of markets and the stats known. Names are blocked on keys that every
    accepting rule shares. Distinct legs meet distinct offers, each with its first selection, so the rows of a popular name
    are never multiplied. With ``half_points`` Over L also takes L + .5 and Under L takes L - .5 (milestones). With
    ``prefer_two_way`` selections of O/U subcategories come first.
    """
    best = _best_offers(legs, _offers(props, kind), kind, half_points, prefer_two_way)
    return _for_legs(legs, best, {"selectionId": F.col("offer.selectionId")})


def leg_sides(legs: DataFrame, props: DataFrame, kind: str = "batter", half_points: bool = True, prefer_two_way: bool = False) -> DataFrame:
    """``match_legs`` with the other side: opposite_id, over_odds and under_odds.

    The other side is the first selection of the class, by the same rules for name and stat, that has the other direction, and the points and
    subcategory (null is the empty one) of the selection that was matched. Where there is none, its odds are null.
    """
    offers = _offers(props, kind)
    best = _best_offers(legs, offers, kind, half_points, prefer_two_way)
    wanted = best.withColumn("pa", text.plain_name(F.col("player"))).select(*_LEG, "pa", F.col("offer").alias("own"), F.when(F.col("direction") == "Over", "Under").otherwise("Over").alias("side"), F.explode(name_blocks(F.col("pa"))).alias("block"))
    others = offers.select("block", F.col("direction").alias("side"), "points", "shelf", "pb", "blob", "offer")
    on = [wanted[c] == others[c] for c in ("block", "side")] + [F.col("own.points") == others["points"], F.col("own.shelf") == others["shelf"]]
    met = wanted.join(others, on).where(_speaks(kind)).groupBy(*_LEG).agg(F.min("offer").alias("other"))
    same = reduce(lambda x, y: x & y, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _LEG))
    both = best.alias("l").join(met.alias("r"), same, "left").select(*(F.col(f"l.{c}").alias(c) for c in _LEG), "offer", "other")
    over = F.col("direction") == "Over"
    values = {"selectionId": F.col("offer.selectionId"), "opposite_id": F.col("other.selectionId"), "over_odds": F.when(over, F.col("offer.price")).otherwise(F.col("other.price")), "under_odds": F.when(over, F.col("other.price")).otherwise(F.col("offer.price"))}
    return _for_legs(legs, both, values)


def opposite_sides(props: DataFrame) -> DataFrame:
    """selectionId, over_odds and under_odds: its own odds and those of the first other side of the same player, stat, points and subcategory (null is the empty one)."""
    key = ["player", "stat", "points", "shelf"]
    x = props.withColumn("direction", text.selection_direction(F.col("outcomeType"))).where("direction is not null").withColumn("shelf", F.coalesce("subcategory", F.lit("")))
    firsts = x.groupBy(*key, "direction").agg(F.min_by("oddsAmerican", "feed_pos").alias("other"))
    y = x.withColumn("want", F.when(F.col("direction") == "Over", "Under").otherwise("Over")).join(firsts.withColumnRenamed("direction", "want"), [*key, "want"], "left")
    over = F.col("direction") == "Over"
    return y.select("selectionId", F.when(over, F.col("oddsAmerican")).otherwise(F.col("other")).alias("over_odds"), F.when(over, F.col("other")).otherwise(F.col("oddsAmerican")).alias("under_odds"))


def team_events(teams: DataFrame, events: DataFrame, cities: list[str]) -> DataFrame:
    """For each team the first event (by start, id) that lists its nickname at home or away, in full or short."""
    names = F.array_distinct(F.array(*(text.nickname(F.col(c), cities) for c in ("homeTeam", "awayTeam")), F.lower("homeShort"), F.lower("awayShort")))
    by_name = events.select("id", "start_date", F.explode(names).alias("nick")).groupBy("nick").agg(F.min(F.struct("start_date", "id")).alias("e"))
    return teams.withColumn("nick", text.nickname(F.col("team"), cities)).join(by_name, "nick", "left").select("team", "nick", F.col("e.id").alias("event_id"))


# Words between two teams in a game's text, and the longest that a team's short code is.
BETWEEN, CODE = ("vs", "at", "v"), 4

GRAM = 3  # characters


def _grams(held: Column, sizes: range) -> Column:
    """The distinct runs of characters of a text, of each size."""

    def runs(size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(held) - size + 1, F.lit(1))), lambda i: F.substring(held, i, F.lit(size)))

    return F.filter(F.array_distinct(F.flatten(F.array(*map(runs, sizes)))), lambda g: g != "")


def _own_grams(held: Column) -> Column:
    """Runs that any text must have that holds this one: those of ``GRAM`` characters, or the text itself if it is shorter."""
    return F.when(F.length(held) < GRAM, F.array(held)).otherwise(_grams(held, range(GRAM, GRAM + 1)))


def holding(small: DataFrame, needs: Column, big: DataFrame, text_column: str, confirm: Column) -> DataFrame:
    """The pairs of rows of ``small`` and ``big`` for which ``confirm`` holds, where a match's text has all runs that ``needs`` lists.

    An inverted index from runs of characters to the texts of ``big`` serves as the join key: a row of ``small`` goes by the rarest of its runs, and not
    at all if one of them is in no text. So rows meet by an equi-join, and only texts that share a rare run are compared.
    """
    index = big.select("*", F.explode(_grams(F.col(text_column), range(1, GRAM + 1))).alias("__gram"))
    spread = index.groupBy("__gram").agg(F.count("*").alias("__n"))
    row = F.struct(*small.columns)
    asked = small.select(row.alias("__row"), F.explode(needs).alias("__gram")).join(spread, "__gram", "left")
    rarest = asked.groupBy("__row").agg(F.count_if(F.col("__n").isNull()).alias("__absent"), F.min(F.struct("__n", "__gram")).alias("__best")).where("__absent = 0")
    met = rarest.select("__row.*", F.col("__best.__gram").alias("__gram")).join(index, "__gram")
    return met.where(confirm).drop("__gram")


def events_of_games(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """The first event (by feed_pos) of each candidate (game_id, team, game), and the rule that found it; null where none does.

    A team is looked for first: 1, an event whose short code it is, or one of whose teams' names holds it or is held by it. Without one, a
    game of two words of up to four letters (words as vs apart) names the event with just these codes: 2. Else the event
    all words of whose teams' names the game's text holds: 3.

    Distinct texts meet distinct names, not rows. Codes meet as keys; what holds what goes by an index of runs of characters (``holding``).
    """
    key = lambda c: text.team_key(F.col(c))
    c = candidates.select("team", "game").distinct().select("team", "game", key("team").alias("tn"), key("game").alias("gn"))
    codes = [F.lower(F.coalesce(F.col(k), F.lit(""))) for k in ("homeShort", "awayShort")]
    e = events.select("id", "feed_pos", *(x.alias(k) for x, k in zip(codes, ("hs", "as"))), key("homeTeam").alias("ht"), key("awayTeam").alias("at"))
    at = F.struct("feed_pos", "id").alias("e")
    teams = c.where("tn <> ''").select("tn").distinct()
    by_code = e.select(F.explode(F.array("hs", "as")).alias("tn"), at).groupBy("tn").agg(F.min("e").alias("e"))
    names = e.select(F.explode(F.array("ht", "at")).alias("name"), at).where("name <> ''").groupBy("name").agg(F.min("e").alias("e"))
    within = holding(teams, _own_grams(F.col("tn")), names, "name", F.col("name").contains(F.col("tn"))).select("tn", "e")
    inside = within.union(holding(names, _own_grams(F.col("name")), teams, "tn", F.col("tn").contains(F.col("name"))).select("tn", "e"))
    found = teams.join(by_code, "tn").select("tn", "e").union(inside).groupBy("tn").agg(F.min("e").alias("by_team"))
    games = c.where("gn <> ''").select("gn").distinct().withColumn("parts", F.filter(F.split("gn", " "), lambda w: ~w.isin(*BETWEEN)))
    pair = lambda a, b: F.concat_ws(" ", F.least(a, b), F.greatest(a, b))
    two = (F.size("parts") == 2) & F.forall("parts", lambda w: F.length(w) <= CODE)
    by_codes = e.select(pair(F.col("hs"), F.col("as")).alias("pair"), at).groupBy("pair").agg(F.min("e").alias("by_codes"))
    coded = games.where(two).select("gn", pair(F.get("parts", F.lit(0)), F.get("parts", F.lit(1))).alias("pair")).join(by_codes, "pair").select("gn", "by_codes")
    fixtures = e.where("ht <> '' and at <> ''").groupBy("ht", "at").agg(F.min(at).alias("e"))
    every = lambda side: F.forall(F.split(side, " "), lambda w: F.col("gn").contains(w))
    words = F.array_distinct(F.flatten(F.transform(F.split(F.concat_ws(" ", "ht", "at"), " "), _own_grams)))
    told = holding(fixtures, words, games.select("gn"), "gn", every("ht") & every("at")).groupBy("gn").agg(F.min("e").alias("by_names"))
    out = c.join(found, "tn", "left").join(coded, "gn", "left").join(told, "gn", "left")
    out = out.select(F.col("team").alias("__team"), F.col("game").alias("__game"), F.coalesce("by_team", "by_codes", "by_names").alias("e"), F.when(F.col("by_team").isNotNull(), 1).when(F.col("by_codes").isNotNull(), 2).when(F.col("by_names").isNotNull(), 3).alias("rule"))
    held = candidates.join(out, F.col("team").eqNullSafe(F.col("__team")) & F.col("game").eqNullSafe(F.col("__game")), "left")
    return held.select("game_id", F.col("e.id").alias("event_id"), "rule")


def player_events(players: DataFrame, props: DataFrame) -> DataFrame:
    """The event of the first selection that names each distinct player; null where none does. Distinct names meet, not rows."""
    a = players.select("player").distinct().withColumn("pa", text.plain_name(F.col("player")))
    b = props.groupBy(text.plain_name(F.col("player")).alias("pb")).agg(F.min(F.struct("feed_pos", "eventId")).alias("e"))
    met = a.withColumn("block", F.explode(name_blocks(F.col("pa")))).join(b.withColumn("block", F.explode(name_blocks(F.col("pb")))), "block")
    hit = met.where(text.names_match(F.col("pa"), F.col("pb"))).groupBy("player").agg(F.min("e").alias("e"))
    return a.select("player").join(hit, "player", "left").select("player", F.col("e.eventId").alias("event_id"))


SHARE = 64  # legs of an entity that a key holds


def leg_combos(legs: DataFrame, size: int = 2, share: int = SHARE) -> DataFrame:
    """All combos of an entity's matched legs (player, leg), each ordered by stat category.

    An entity's distinct legs are numbered in that order and cut into shares; a combo's legs meet under the numbers of their shares, so the
    square or cube of one entity with many legs is made by many tasks, none of which holds more than its shares.
    """
    cat = text.stat_category(F.col("leg"))
    named = legs.where("leg is not null").select(F.coalesce("player", F.lit("")).alias("who"), F.col("player").isNull().alias("nobody"), cat.alias("cat"), "leg").distinct()
    entity = ["who", "nobody"]
    held = named.withColumn("at", F.row_number().over(Window.partitionBy(*entity).orderBy("cat", "leg")) - 1)
    held = held.join(held.groupBy(*entity).agg(F.floor(F.max("at") / share).cast("int").alias("last")), entity).withColumn("own", F.floor(F.col("at") / share).cast("int"))
    out, keys = None, [f"s{i}" for i in range(size)]
    for i in range(size):
        part = held.select(*entity, F.col("leg").alias(f"leg{i + 1}"), F.col("at").alias(f"at{i}"), "own", "last")
        for k in range(size):  # the leg stands in place i: the shares before it are no later than its own, those after no earlier
            low = F.lit(0) if k == 0 else F.col(f"s{k - 1}")
            part = part.withColumn(f"s{k}", F.col("own") if k == i else F.explode(F.sequence(low, F.col("own" if k < i else "last"))))
        part = part.drop("own", "last")
        out = part if out is None else out.join(part, [*entity, *keys]).where(F.col(f"at{i - 1}") < F.col(f"at{i}"))
    return out.select(F.when(~F.col("nobody"), F.col("who")).alias("player"), *(f"leg{i + 1}" for i in range(size)))


def price_requests(pairs: DataFrame) -> DataFrame:
    """Distinct unordered pairs of selections of an event; a pair with a side missing asks for nothing."""
    whole = pairs.where("selection_a is not null and selection_b is not null")
    return whole.select("event_id", F.least("selection_a", "selection_b").alias("a"), F.greatest("selection_a", "selection_b").alias("b")).distinct()
