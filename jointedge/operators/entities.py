"""Per-entity hit rates and correlations of threshold events, by season, over all entities, and pooled over seasons.

Each row becomes one bit mask of the events that hold, and rows are counted by (season, entity, mask) before any combo is looked
at, with map-side counts. An entity's masks then meet in one partition, where one aggregation makes the sums of all combos: only rows of
masks are shuffled, and neither the number of combos nor of schemes touches them again. Where entities don't matter, rows are
counted by (season, mask) alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shrink import mean_of, shrunk_entity_r
from ..functions.text import leg_hits
from .moments import dot, pair_sums, pearson, percent, phi, rounded_ratio, weighted_pearson
from .weights import normalised, with_numbers, with_rows, with_schemes

Leg = tuple[str, float, str]

PAIR_SUMS = ("n", "n1", "n2", "n11")
TRIPLE_SUMS = ("n", "n1", "n2", "n3", "n12", "n13", "n23", "n123", "n000")
RAW_SUMS = ("n", "x", "y", "xx", "yy", "xy")
SIDES = ((1, 2), (1, 3), (2, 3))


def leg_name(leg: Leg) -> str:
    return f"{leg[0]} {leg[1]} {leg[2]}"


WORD = 62  # bits of a mask's word
AT_ONCE = 64  # combos whose sums one aggregation makes


def _words(ones: list[Column], name: str) -> list[Column]:
    """One bit per column of 0 or 1, in as many longs as they need."""
    out = []
    for word, first in enumerate(range(0, len(ones), WORD)):
        bits = F.lit(0).cast("long")
        for i, one in enumerate(ones[first : first + WORD]):
            bits = bits + one.cast("long") * (1 << i)
        out.append(bits.alias(f"{name}{word}"))
    return out


def mask_words(legs: list[Leg], name: str = "mask") -> list[Column]:
    """One bit per event, in as many longs (mask0, mask1, ...) as the legs need."""
    return _words([leg_hits(F.col(stat), direction, threshold) for direction, threshold, stat in legs], name)


def _all_set(bits: tuple[int, ...], name: str = "mask") -> str:
    """SQL: whether all of the bits are set in the words."""
    words: dict[int, int] = {}
    for b in bits:
        words[b // WORD] = words.get(b // WORD, 0) | 1 << b % WORD
    return " AND ".join(f"{name}{w} & {v}L = {v}L" for w, v in words.items())


def masks(rows: DataFrame, legs: list[Leg]) -> DataFrame:
    """season, p, mask0.., cnt: how many rows of an entity's season have exactly these events. Any number of legs."""
    return rows.where("p is not null").groupBy("season", "p", *mask_words(legs)).agg(F.count("*").alias("cnt"))


def combos_of(legs: list[Leg], size: int, distinct_stats: bool = False) -> list[tuple[int, ...]]:
    """idx and leg numbers of all combos of ``size`` legs; a few hundred rows."""
    kept = [x for x in combinations(range(len(legs)), size) if not distinct_stats or len({legs[i][2] for i in x}) == size]
    return [(i, *x) for i, x in enumerate(kept)]


def _combo_counts(counted: DataFrame, combos: list[tuple[int, ...]], legs: str, more: dict[str, list[Column]] | None = None) -> DataFrame:
    """season, p, idx, a, b, .. and n, n1, .., n12, .. of every entity's season and combo, and an array of each list of further sums.

    An entity's masks, at most as many as its rows, meet in one partition. There one aggregation makes one row with the sum of each set of legs
    that a combo asks for, and the combos look theirs up: no row of a combo is shuffled or hashed. A large spec takes its combos by shares.
    """
    held = counted.repartition("season", "p")
    shares = [combos[i : i + AT_ONCE] for i in range(0, len(combos), AT_ONCE)] or [[]]
    return reduce(DataFrame.union, [_counts_of(held, share, legs, more or {}) for share in shares])


def _counts_of(held: DataFrame, combos: list[tuple[int, ...]], legs: str, more: dict[str, list[Column]]) -> DataFrame:
    sets = [x for size in range(1, len(legs) + 1) for x in combinations(range(len(legs)), size)]
    legs_of = lambda combo, x: tuple(sorted(combo[1 + i] for i in x))
    asked = {size: sorted({legs_of(c, x) for c in combos for x in sets if len(x) == size}) for size in range(1, len(legs) + 1)}
    place = {v: i for held_legs in asked.values() for i, v in enumerate(held_legs)}
    sums = {f"of{size}": [F.expr(f"sum(if({_all_set(v)}, cnt, 0L))") for v in held_legs] for size, held_legs in asked.items()} | more
    wide = held.groupBy("season", "p").agg(F.sum("cnt").alias("n"), *(c.alias(f"{k}_{i}") for k, cs in sums.items() for i, c in enumerate(cs)))
    one = wide.select("season", "p", "n", *((F.array(*(f"{k}_{i}" for i in range(len(cs)))) if cs else F.array().cast("array<bigint>")).alias(k) for k, cs in sums.items()))
    name = lambda x: "".join(str(i + 1) for i in x)
    looked = with_numbers(one, ["idx", *legs, *(f"at{name(x)}" for x in sets)], [(*c, *(place[legs_of(c, x)] for x in sets)) for c in combos])
    return looked.select("season", "p", "idx", *legs, "n", *(F.get(F.col(f"of{len(x)}"), F.col(f"at{name(x)}")).alias(f"n{name(x)}") for x in sets), *more)


def pair_counts(counted: DataFrame, combos: list[tuple[int, ...]]) -> DataFrame:
    """season, p, idx, a, b, n, n1, n2, n11 for every entity's season and combo."""
    return _combo_counts(counted, combos, "ab").withColumnRenamed("n12", "n11")


def triple_counts(counted: DataFrame, combos: list[tuple[int, ...]]) -> DataFrame:
    x = _combo_counts(counted, combos, "abc")
    none = F.expr("n - n1 - n2 - n3 + n12 + n13 + n23 - n123")  # by inclusion and exclusion
    return x.select("season", "p", "idx", "a", "b", "c", *TRIPLE_SUMS[:-1], none.alias("n000"))


def season_counts(rows: DataFrame, legs: list[Leg], combos: list[tuple[int, ...]], named: str) -> DataFrame:
    """season, idx, a, b, .. and n, n1, .., n12, .. of every season and combo over all rows with an entity.

    Rows are counted by season and mask, however many entities there are, and each count meets each combo in a sum over the season: the legs'
    thresholds bound the masks, and the combos bound the rows that leave a task.
    """
    counted = rows.where("p is not null").groupBy("season", *mask_words(legs)).agg(F.count("*").alias("cnt"))
    words = F.array(*[c for c in counted.columns if c.startswith("mask")])
    x = with_numbers(counted.select("season", "cnt", words.alias("words")), ["idx", *named], combos)
    sets = [v for size in range(1, len(named) + 1) for v in combinations(range(len(named)), size)]
    hit = [F.expr(f"shiftright(get(words, {k} div {WORD}), {k} % {WORD}) & 1L") for k in named]
    x = x.select("season", "idx", *named, "cnt", *(h.alias(f"h{i}") for i, h in enumerate(hit)))
    sums = [F.sum(reduce(lambda a, i: a * F.col(f"h{i}"), v, F.col("cnt"))).alias("n" + "".join(str(i + 1) for i in v)) for v in sets]
    return x.groupBy("season", "idx", *named).agg(F.sum("cnt").alias("n"), *sums)


def raw_sums(rows: DataFrame, stats: list[str]) -> DataFrame:
    """season, p, rows, s1, s2 and the sums of each pair of stats over rows that have both; one wide aggregation, then one row per pair."""
    pairs = list(combinations(stats, 2))
    wide = rows.where("p is not null").groupBy("season", "p").agg(F.count("*").alias("rows"), *(c for a, b in pairs for c in pair_sums(F.col(a), F.col(b), f"{a}_{b}_")))
    structs = [F.struct(F.lit(a).alias("s1"), F.lit(b).alias("s2"), *(F.col(f"{a}_{b}_{k}").alias(k) for k in RAW_SUMS)) for a, b in pairs]
    return wide.select("season", "p", "rows", F.explode(F.array(*structs)).alias("v")).select("season", "p", "rows", "v.*")


def raw_r() -> Column:
    return F.round(pearson(*(F.col(k) for k in RAW_SUMS)), 4)


def global_raw(raw: DataFrame) -> DataFrame:
    """The stats' correlations over all rows of a season, from the entities' sums."""
    sums = raw.groupBy("season", "s1", "s2").agg(*(F.sum(k).alias(k) for k in RAW_SUMS))
    return sums.select("season", "s1", "s2", F.coalesce("n", F.lit(0)).alias("n"), raw_r().alias("r"))


def entity_means(rows: DataFrame, stats: list[str]) -> DataFrame:
    """Per season and entity: rows, and the mean of each stat over rows that have it, two decimals."""
    return rows.where("p is not null").groupBy("season", "p").agg(F.count("*").alias("n"), *(rounded_ratio(F.sum(s), F.count(s), 100).alias(f"avg_{s}") for s in stats))


def conditional(both: str, hit: str) -> Column:
    """The conditional rate from two rates that are rounded to tenths of a percent, in whole tenths."""
    tenths = lambda c: F.round(F.col(c) * 10).cast("long")
    return percent(tenths(both), tenths(hit))


def pair_report(rows: DataFrame, legs: list[Leg], combos: list[tuple[int, ...]], stats: list[str], same_stat: bool = False) -> DataFrame:
    """r, r_margin, hit1, hit2, both, given1 of each combo; same-stat combos and combos without any r are left out.

    Rows are read once: an entity's season is counted by mask and by which stats are there, together with the stats' sums, and its counts meet in
    one partition, where one aggregation makes the sums of combos and of pairs of stats.
    """
    combos = [(i, *c[1:]) for i, c in enumerate(c for c in combos if same_stat or legs[c[1]][2] != legs[c[2]][2])]
    sides = list(combinations(range(len(stats)), 2))
    side_of = {frozenset((stats[i], stats[j])): k for k, (i, j) in enumerate(sides)}
    there = _words([F.col(s).isNotNull() for s in stats], "there")
    parts = {**{f"x{i}": F.col(s) for i, s in enumerate(stats)}, **{f"x{i}_{j}": F.col(stats[i]) * F.col(stats[j]) for i in range(len(stats)) for j in range(i, len(stats))}}
    counted = rows.where("p is not null").groupBy("season", "p", *mask_words(legs), *there).agg(F.count("*").alias("cnt"), *(F.sum(v).alias(k) for k, v in parts.items()))
    of = {"n": "cnt", "x": "x{0}", "y": "x{1}", "xx": "x{0}_{0}", "yy": "x{1}_{1}", "xy": "x{0}_{1}"}
    raw = {f"all_{k}": [F.expr(f"sum(if({_all_set(v, 'there')}, {of[k].format(*v)}, null))") for v in sides] for k in RAW_SUMS}
    pairs = _combo_counts(counted, combos, "ab", raw)
    margin = F.get(F.array(*(F.lit(side_of.get(frozenset((legs[x[1]][2], legs[x[2]][2])), len(sides))) for x in combos)), F.col("idx"))
    name = F.array(*(F.lit(leg_name(x)) for x in legs))
    n, n1, n2, n11 = (F.col(k) for k in ("n", "n1", "n2", "n12"))
    told = pairs.select(
        "season", "p", F.get(name, F.col("a")).alias("leg1"), F.get(name, F.col("b")).alias("leg2"), "n", F.round(phi(n, n1, n2, n11), 4).alias("r"), F.round(pearson(*(F.get(F.col(f"all_{k}"), margin) for k in RAW_SUMS)), 4).alias("r_margin"),
        percent(n1, n).alias("hit1"), percent(n2, n).alias("hit2"), percent(n11, n).alias("both"),
    )
    # the conditional comes from the rounded rates
    return told.where(F.coalesce("r", "r_margin").isNotNull()).withColumn("given1", conditional("both", "hit1"))


def mean_r(*names: str) -> Column:
    """The mean of the correlations that are there; null without any."""
    total = reduce(lambda a, v: a + F.coalesce(F.col(v), F.lit(0.0)), names, F.lit(0.0))
    return F.round(F.try_divide(total, reduce(lambda a, v: a + F.col(v).isNotNull().cast("int"), names, F.lit(0))), 4)


def triple_report(counts: DataFrame, legs: list[Leg]) -> DataFrame:
    """r12, r13, r23, their mean, hit1..3, all3 and none (counted) of each combo that has any r.

    Correlations and shares leave generators, so that the filter and the mean don't repeat their arithmetic and each is compiled apart: as one
    projection they are too large for the JVM to compile.
    """
    name = F.array(*(F.lit(leg_name(x)) for x in legs))
    c = {k: F.col(k) for k in TRIPLE_SUMS}
    once = lambda *columns: F.inline(F.array(F.struct(*columns)))
    x = counts.select("*", once(*(F.round(phi(c["n"], c[f"n{i}"], c[f"n{j}"], c[f"n{i}{j}"]), 4).alias(f"r{i}{j}") for i, j in SIDES))).where("coalesce(r12, r13, r23) is not null")
    told = {"hit1": "n1", "hit2": "n2", "hit3": "n3", "all3": "n123", "none3": "n000"}
    x = x.select("*", once(*(percent(c[v], c["n"]).alias(k) for k, v in told.items())))
    return x.select("season", "p", *(F.get(name, F.col(k)).alias(f"leg{i}") for i, k in enumerate("abc", 1)), "n", "r12", "r13", "r23", *told, mean_r("r12", "r13", "r23").alias("avg_r"))


def global_pairs(counts: DataFrame, legs: list[Leg]) -> DataFrame:
    """Combos over all rows of a season, and r_avg, the correlation between entities of their mean hit rates.

    Works on the entities' counts, not on rows. Same-stat combos are kept. neither comes from the rounded rates.
    """
    name = F.array(*(F.lit(leg_name(x)) for x in legs))
    x, y = F.col("n1") / F.col("n"), F.col("n2") / F.col("n")
    g = counts.groupBy("season", "a", "b").agg(
        *(F.sum(k).alias(k) for k in ("n", "n1", "n2", "n11")), F.count("*").alias("entities"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"),
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"),
    )
    n, n1, n2, n11 = (F.col(k) for k in ("n", "n1", "n2", "n11"))
    r_avg = F.when((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")), F.round(pearson(*(F.col(k) for k in ("entities", "x", "y", "xx", "yy", "xy"))), 4))
    out = g.select(
        "season", F.get(name, F.col("a")).alias("leg1"), F.get(name, F.col("b")).alias("leg2"), "n", "entities", F.round(phi(n, n1, n2, n11), 4).alias("r"), r_avg.alias("r_avg"),
        percent(n1, n).alias("hit1"), percent(n2, n).alias("hit2"), percent(n11, n).alias("both"),
    )
    return out.withColumn("neither", F.round(100 - F.col("hit1") - F.col("hit2") + F.col("both"), 1)).withColumn("given1", conditional("both", "hit1")).withColumn("given2", conditional("both", "hit2"))


def global_triples(counts: DataFrame, legs: list[Leg]) -> DataFrame:
    """Triples over all rows of a season, and between entities (r12a, r13a, r23a, avg_ra) the correlations of their mean hit rates.

    Works on the entities' counts, not on rows; neither is counted.
    """
    name = F.array(*(F.lit(leg_name(x)) for x in legs))
    rate = {i: F.col(f"n{i}") / F.col("n") for i in (1, 2, 3)}
    between = [F.count("*").alias("entities"), *(F.sum(rate[i] * rate[j]).alias(f"x{i}{j}") for i, j in SIDES)]
    for i, u in rate.items():
        between += [F.sum(u).alias(f"x{i}"), F.sum(u * u).alias(f"q{i}"), (F.min(u) < F.max(u)).alias(f"varies{i}")]
    g = counts.groupBy("season", "a", "b", "c").agg(*(F.sum(k).alias(k) for k in TRIPLE_SUMS), *between)
    col, n = F.col, F.col("n")
    r = [F.round(phi(n, col(f"n{i}"), col(f"n{j}"), col(f"n{i}{j}")), 4).alias(f"r{i}{j}") for i, j in SIDES]
    ra = [F.when(col(f"varies{i}") & col(f"varies{j}"), F.round(pearson(col("entities"), col(f"x{i}"), col(f"x{j}"), col(f"q{i}"), col(f"q{j}"), col(f"x{i}{j}")), 4)).alias(f"r{i}{j}a") for i, j in SIDES]
    x = g.select("season", *(F.get(name, col(k)).alias(f"leg{i}") for i, k in enumerate("abc", 1)), "n", "entities", *r, *ra, *(percent(col(f"n{i}"), n).alias(f"hit{i}") for i in (1, 2, 3)), percent(col("n123"), n).alias("all3"), percent(col("n000"), n).alias("neither"))
    return x.withColumn("avg_r", mean_r("r12", "r13", "r23")).withColumn("avg_ra", mean_r("r12a", "r13a", "r23a"))


def season_pairs(rows: DataFrame, legs: list[Leg], combos: list[tuple[int, ...]]) -> DataFrame:
    """What ``global_pairs`` tells of a season's rows, for specs of any size: nothing is kept by entity but which there are."""
    name = F.array(*(F.lit(leg_name(x)) for x in legs))
    known = rows.where("p is not null").select("season", "p").distinct().groupBy(F.col("season").alias("of")).agg(F.count("*").alias("entities"))
    g = season_counts(rows, legs, combos, "ab").join(F.broadcast(known), F.col("season").eqNullSafe(F.col("of")), "left")  # a row a season
    n, n1, n2, n11 = (F.col(k) for k in ("n", "n1", "n2", "n12"))
    return g.select(
        "season", F.get(name, F.col("a")).alias("leg1"), F.get(name, F.col("b")).alias("leg2"), "n", "entities", F.round(phi(n, n1, n2, n11), 4).alias("r"),
        percent(n1, n).alias("hit1"), percent(n2, n).alias("hit2"), percent(n11, n).alias("both"),
    )


def season_triples(rows: DataFrame, legs: list[Leg], combos: list[tuple[int, ...]]) -> DataFrame:
    """What ``global_triples`` tells of a season's rows, for specs of any size."""
    name = F.array(*(F.lit(leg_name(x)) for x in legs))
    g = season_counts(rows, legs, combos, "abc")
    n = F.col("n")
    r = [F.round(phi(n, F.col(f"n{i}"), F.col(f"n{j}"), F.col(f"n{i}{j}")), 4).alias(f"r{i}{j}") for i, j in SIDES]
    none = F.expr("n - n1 - n2 - n3 + n12 + n13 + n23 - n123")
    return g.select("season", *(F.get(name, F.col(k)).alias(f"leg{i}") for i, k in enumerate("abc", 1)), "n", *r, percent(F.col("n123"), n).alias("all3"), percent(none, n).alias("neither"))


def by_season(df: DataFrame, keys: list[str], sums: list[str], seasons: list[int]) -> DataFrame:
    """One row per key with each sum of each season in a column of its own (name_0 .. name_3)."""
    return df.groupBy(*keys).agg(*(F.sum(F.when(F.col("season") == s, F.col(k))).alias(f"{k}_{i}") for k in sums for i, s in enumerate(seasons)))


def pooled_sums(df: DataFrame, keys: list[str], sums: list[str], present: str, schemes: dict[str, tuple[float, ...]], seasons: list[int]) -> DataFrame:
    """Per scheme and key the season sums, weighted by the normalised weights of the seasons where ``present`` is not null.

    The sums leave as the one row of a generator: a later filter on what is made of them cannot be pushed below it, where
    it would repeat all the arithmetic.
    """
    span = range(len(seasons))
    x = with_schemes(by_season(df.where(F.col("season").isin(*seasons)), keys, sums, seasons), schemes)
    w = normalised([F.col(f"{present}_{i}").isNotNull() for i in span], [F.col(f"w{i}") for i in span], F.col("pin"))
    x = x.withColumns({f"v{i}": c for i, c in enumerate(w)})
    total = F.struct(*(dot([F.col(f"{k}_{i}") for i in span], [F.col(f"v{i}") for i in span]).alias(k) for k in sums))
    return x.select("scheme", *keys, F.inline(F.array(total)))


def pooled_pairs(counts: DataFrame, legs: list[Leg], schemes: dict[str, tuple[float, ...]], seasons: list[int]) -> DataFrame:
    """Combos per scheme and entity, each row weighted by its season's normalised weight; n_eff is the weighted number of rows."""
    name = F.array(*(F.lit(leg_name(x)) for x in legs))
    x = pooled_sums(counts, ["p", "a", "b"], list(PAIR_SUMS), "n", schemes, seasons)
    rate = lambda k: F.round(F.try_divide(F.col(k) * 100, F.col("n")), 1)
    r = phi(*(F.col(k) for k in PAIR_SUMS))
    return x.select("scheme", "p", F.get(name, F.col("a")).alias("leg1"), F.get(name, F.col("b")).alias("leg2"), F.round("n", 3).alias("n_eff"), F.round(r, 4).alias("r"), rate("n1").alias("hit1"), rate("n2").alias("hit2"), rate("n11").alias("both"))


def pooled_triples(counts: DataFrame, legs: list[Leg], schemes: dict[str, tuple[float, ...]], seasons: list[int]) -> DataFrame:
    """Triples per scheme and entity, weighted as in ``pooled_pairs``; those without any r are left out."""
    name = F.array(*(F.lit(leg_name(x)) for x in legs))
    x = pooled_sums(counts, ["p", "a", "b", "c"], list(TRIPLE_SUMS[:-1]), "n", schemes, seasons)
    col, n = F.col, F.col("n")
    rate = lambda k: F.floor(F.try_divide(col(k) * 100, n) * 10 + 0.5) / 10
    r = [F.round(phi(n, col(f"n{i}"), col(f"n{j}"), col(f"n{i}{j}")), 4).alias(f"r{i}{j}") for i, j in SIDES]
    x = x.select("scheme", "p", *(F.get(name, col(k)).alias(f"leg{i}") for i, k in enumerate("abc", 1)), *r, *(rate(f"n{i}").alias(f"hit{i}") for i in (1, 2, 3)), rate("n123").alias("all3"))
    return x.withColumn("avg_r", mean_r("r12", "r13", "r23")).where("coalesce(r12, r13, r23) is not null")


def pooled_raw(raw: DataFrame, schemes: dict[str, tuple[float, ...]], seasons: list[int]) -> DataFrame:
    """The stats' correlations per scheme and entity; a season is present where the entity has rows, complete or not."""
    x = pooled_sums(raw, ["p", "s1", "s2"], ["rows", *RAW_SUMS], "rows", schemes, seasons)
    return x.select("scheme", "p", "s1", "s2", F.round(weighted_pearson(*(F.col(k) for k in RAW_SUMS)), 4).alias("r"))


def pooled_means(rows: DataFrame, stats: list[str], schemes: dict[str, tuple[float, ...]], seasons: list[int]) -> DataFrame:
    """Weighted mean of each stat per scheme and entity over the rows that have it, two decimals."""
    sums = rows.where("p is not null").groupBy("season", "p").agg(F.count("*").alias("n"), *(F.count(s).alias(f"k_{s}") for s in stats), *(F.sum(s).alias(f"t_{s}") for s in stats))
    x = pooled_sums(sums, ["p"], ["n", *(f"{k}_{s}" for s in stats for k in "kt")], "n", schemes, seasons)
    mean = lambda s: F.floor(F.try_divide(F.col(f"t_{s}"), F.when(F.col(f"k_{s}") > 0, F.col(f"k_{s}"))) * 100 + 0.5) / 100
    return x.select("scheme", "p", F.round("n", 3).alias("n_eff"), *(mean(s).alias(f"avg_{s}") for s in stats))


def pooled_report(pooled: DataFrame, raw: DataFrame, legs: list[Leg]) -> DataFrame:
    """``pooled_pairs`` with r_margin from ``pooled_raw`` and given1; same-stat combos and those without any r are left out."""
    stats = F.create_map(*(F.lit(v) for leg in legs for v in (leg_name(leg), leg[2])))
    stat = lambda leg: F.element_at(stats, F.col(leg))
    x = pooled.withColumn("lo", F.least(stat("leg1"), stat("leg2"))).withColumn("hi", F.greatest(stat("leg1"), stat("leg2"))).where("lo <> hi")
    margins = raw.select("scheme", "p", F.least("s1", "s2").alias("lo"), F.greatest("s1", "s2").alias("hi"), F.col("r").alias("r_margin"))
    x = x.join(margins, ["scheme", "p", "lo", "hi"], "left").drop("lo", "hi")
    return x.where("coalesce(r, r_margin) is not null").withColumn("given1", conditional("both", "hit1"))


def distinct_legs(*reports: DataFrame) -> DataFrame:
    """The legs that any of the reports names."""
    columns = lambda df: [c for c in df.columns if c.startswith("leg")]
    each = [df.select(F.explode(F.array(*columns(df))).alias("leg")).distinct() for df in reports]
    return reduce(DataFrame.union, each).distinct()


def entity_seasons(rows: DataFrame, seasons: list[int]) -> DataFrame:
    """Per entity: rows by season (a map with zeros) and the seasons it has."""
    n = rows.where("p is not null").groupBy("p").agg(*(F.count_if(F.col("season") == s).alias(f"s{s}") for s in seasons))
    pairs = F.array(*(F.struct(F.lit(s).alias("k"), F.col(f"s{s}").alias("v")) for s in seasons))
    return n.select("p", F.map_from_entries(pairs).alias("starts_by_year"), F.transform(F.filter(pairs, lambda x: x["v"] > 0), lambda x: x["k"]).alias("years"))


def pooled_weights(rows: DataFrame, schemes: dict[str, tuple[float, ...]], seasons: list[int]) -> DataFrame:
    """scheme, p and the normalised weight of each season that an entity has rows of (weight_0 ..), four decimals; null for the others."""
    n = rows.where(F.col("p").isNotNull() & F.col("season").isin(*seasons)).groupBy("p").agg(*(F.count_if(F.col("season") == s).alias(f"n_{i}") for i, s in enumerate(seasons)))
    x = with_schemes(n, schemes)
    there = [F.col(f"n_{i}") > 0 for i in range(len(seasons))]
    w = normalised(there, [F.col(f"w{i}") for i in range(len(seasons))], F.col("pin"))
    return x.select("scheme", "p", *(F.when(t, F.round(v, 4)).alias(f"weight_{i}") for i, (t, v) in enumerate(zip(there, w))))


def season_blend(df: DataFrame, keys: list[str], value: str, weights: tuple[float, ...], seasons: list[int]) -> DataFrame:
    """base: the weighted mean of the seasons' values (one row per key and season) over the seasons that have one."""
    x = by_season(df, keys, [value], seasons)
    known = [F.col(f"{value}_{i}") for i in range(len(seasons))]
    w = [F.lit(v) for v in weights]
    there = [F.when(k.isNotNull(), 1.0) for k in known]
    return x.select(*keys, F.try_divide(dot(known, w), dot(there, w)).alias("base"))


def shrunk_pairs(pooled: DataFrame, base: DataFrame) -> DataFrame:
    """``pooled`` pairs with base and r drawn toward it by n_eff; a combo without a baseline keeps its own r above the floor."""
    x = pooled.join(base, ["leg1", "leg2"], "left")
    return x.select("p", "leg1", "leg2", "n_eff", "base", shrunk_entity_r(F.col("r"), F.col("base"), F.col("n_eff")).alias("r"))


def shrunk_triples(shrunk: DataFrame, legs: list[Leg]) -> DataFrame:
    """Per entity and triple the mean of its three shrunk pair correlations that are there.

    An entity's pairs (one per combo of the spec) become a map, in which the triples are looked up without a join. Rows without an
    entity have no triples.
    """
    key = lambda a, b: F.concat_ws("#", a, b)
    held = shrunk.where("p is not null").groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct(key("leg1", "leg2").alias("pair"), "r"))).alias("held"))
    x = with_rows(held, ["leg1", "leg2", "leg3"], [tuple(leg_name(v) for v in c) for c in combinations(legs, 3)])
    r = [F.element_at("held", key(f"leg{i}", f"leg{j}")) for i, j in SIDES]
    return x.select("p", "leg1", "leg2", "leg3", mean_of(*r).alias("r"))
