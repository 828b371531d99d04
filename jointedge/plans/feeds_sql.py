"""The queries of ``feeds`` in DuckDB's SQL."""

from __future__ import annotations

from ..sources.adapters import adapted_sql
from .oracle import _DEDUPE, _J, _MARKETS, _NAME, _PROB, _RAW, ATT, BX, ENTITY_LEGS, ENTITY_SCHEMES, GIVEN, HITS, MK, NAMES, QD, QU, SEASONS, SN, SPAN, SQL, ST, STATS, UP, D, _normal, by_season, combos_of, dot, pearson, percent, phi, schemes, values

_SIDES = ((1, 2), (1, 3), (2, 3))
_SUMS3 = ["n", "n1", "n2", "n3", "n12", "n13", "n23", "n123"]
_ALL3 = {"n": "count(*)", **{f"n{i + 1}": f"sum(h[{k}+1])" for i, k in enumerate("abc")}, "n12": "sum(h[a+1]*h[b+1])", "n13": "sum(h[a+1]*h[c+1])", "n23": "sum(h[b+1]*h[c+1])", "n123": "sum(h[a+1]*h[b+1]*h[c+1])", "n000": "sum((1-h[a+1])*(1-h[b+1])*(1-h[c+1]))"}
TRIPLES = f"{ST}, {HITS}, co(idx, a, b, c) AS ({values(combos_of(ENTITY_LEGS, 3))}), tc AS (SELECT season, p, a, b, c, {', '.join(f'CAST({e} AS BIGINT) AS {k}' for k, e in _ALL3.items())} FROM h, co GROUP BY season, p, a, b, c)"
_LEGS3 = ", ".join(f"{NAMES}[{k}+1] AS leg{i}" for i, k in enumerate("abc", 1))
_R3 = ", ".join(f"round({phi('n', f'n{i}', f'n{j}', f'n{i}{j}')}, 4) + 0.0 AS r{i}{j}" for i, j in _SIDES)


def mean_r(tail: str = "") -> str:
    r = [f"r{i}{j}{tail}" for i, j in _SIDES]
    return f"round(({D(0)} + {' + '.join(f'coalesce({x}, 0)' for x in r)}) / nullif({' + '.join(f'({x} IS NOT NULL)::INT' for x in r)}, 0), 4) + 0.0"


def pooled(table: str, keys: str, sums: list[str]) -> str:
    """CTEs up to t: the sums per scheme and key under normalised weights; a season is there where its n is."""
    weighted = ", ".join(dot([f"{k}_{i}" for i in SPAN], [f"v{i}" for i in SPAN]) + f" AS {k}" for k in sums)
    return f"b AS ({by_season(table, keys, sums)}), s AS ({schemes(ENTITY_SCHEMES)}), w AS (SELECT b.*, scheme, {', '.join(_normal())} FROM b, s), t AS (SELECT scheme, {keys}, {weighted} FROM w)"


_BETWEEN = ", ".join([f"sum(u{i}) AS x{i}, sum(u{i}*u{i}) AS q{i}, min(u{i}) < max(u{i}) AS ok{i}" for i in (1, 2, 3)] + [f"sum(u{i}*u{j}) AS x{i}{j}" for i, j in _SIDES])
_RA3 = ", ".join(f"CASE WHEN ok{i} AND ok{j} THEN round({pearson('entities', f'x{i}', f'x{j}', f'q{i}', f'q{j}', f'x{i}{j}')}, 4) + 0.0 END AS r{i}{j}a" for i, j in _SIDES)
SQL["global_triples"] = f"""WITH {TRIPLES}, e AS (SELECT *, {', '.join(f"n{i} / {D('n')} AS u{i}" for i in (1, 2, 3))} FROM tc),
g AS (SELECT season, a, b, c, count(*) AS entities, {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in _ALL3)}, {_BETWEEN} FROM e GROUP BY season, a, b, c),
o AS (SELECT season, {_LEGS3}, n, entities, {_R3}, {_RA3}, {', '.join(percent(f'n{i}', 'n') + f' AS hit{i}' for i in (1, 2, 3))}, {percent('n123', 'n')} AS all3, {percent('n000', 'n')} AS neither FROM g)
SELECT *, {mean_r()} AS avg_r, {mean_r('a')} AS avg_ra FROM o"""
_TENTHS = lambda k: f"floor({k} * 100 / n * 10 + 0.5) / 10"
SQL["pooled_triples"] = f"""WITH {TRIPLES}, {pooled('tc', 'p, a, b, c', _SUMS3)}, o AS (SELECT scheme, p, {_LEGS3}, {_R3}, {', '.join(_TENTHS(f'n{i}') + f' AS hit{i}' for i in (1, 2, 3))}, {_TENTHS('n123')} AS all3 FROM t)
SELECT *, {mean_r()} AS avg_r FROM o WHERE coalesce(r12, r13, r23) IS NOT NULL"""
_WIDE = [(way, low + 0.5, stat) for stat, lows in (("K", range(0, 50, 4)), ("ER", range(10)), ("BB", range(8)), ("H", range(10)), ("OUTS", range(0, 24, 2))) for low in lows for way in ("Over", "Under")][:100]


def _far_combos(size: int, count: int) -> list[tuple[int, ...]]:
    """Legs that stand 18, 25, 32, ... places apart, each round from every leg, if all are of different stats."""
    far = ([(start + part * apart) % 100 for part in range(size)] for apart in range(18, 18 + 7 * 99, 7) for start in range(100))
    kept = [c for c in far if len({_WIDE[k][2] for k in c}) == size]
    return [(i, *c) for i, c in enumerate(kept[:count])]


_WIDE_HITS = "[" + ", ".join(f"CASE WHEN {stat} {'>' if way == 'Over' else '<'} {low} THEN 1 ELSE 0 END" for way, low, stat in _WIDE) + "]"
_WIDE_NAMES = "[" + ", ".join(f"'{way} {low} {stat}'" for way, low, stat in _WIDE) + "]"
_WIDE_LEGS = lambda legs: ", ".join(f"{_WIDE_NAMES}[{k}+1] AS leg{i}" for i, k in enumerate(legs, 1))
_PAIR = {"n1": "h[a+1]", "n2": "h[b+1]", "n11": "h[a+1] * h[b+1]"}
SQL["spec_pairs"] = f"""WITH {ST}, h AS (SELECT season, p, {_WIDE_HITS} AS h FROM st WHERE p IS NOT NULL), co(idx, a, b) AS ({values(_far_combos(2, 166))}),
g AS (SELECT season, a, b, count(*) AS n, count(DISTINCT p) AS entities, {', '.join(f'CAST(sum({v}) AS BIGINT) AS {k}' for k, v in _PAIR.items())} FROM h, co GROUP BY season, a, b)
SELECT season, {_WIDE_LEGS('ab')}, n, entities, round({phi('n', 'n1', 'n2', 'n11')}, 4) + 0.0 AS r, {percent('n1', 'n')} AS hit1, {percent('n2', 'n')} AS hit2, {percent('n11', 'n')} AS both FROM g"""
SQL["spec_triples"] = f"""WITH {ST}, h AS (SELECT season, p, {_WIDE_HITS} AS h FROM st WHERE p IS NOT NULL), co(idx, a, b, c) AS ({values(_far_combos(3, 690))}),
g AS (SELECT season, a, b, c, {', '.join(f'CAST({e} AS BIGINT) AS {k}' for k, e in _ALL3.items())} FROM h, co GROUP BY season, a, b, c)
SELECT season, {_WIDE_LEGS('abc')}, n, {_R3}, {percent('n123', 'n')} AS all3, {percent('n000', 'n')} AS neither FROM g"""
SQL["global_raw"] = f"""WITH {ST}, g AS (SELECT season, s1, s2, {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in ('n', 'x', 'y', 'xx', 'yy', 'xy'))} FROM ({_RAW}) GROUP BY season, s1, s2)
SELECT season, s1, s2, n, round({pearson('n', 'x', 'y', 'xx', 'yy', 'xy')}, 4) + 0.0 AS r FROM g"""
# here n is all rows of a season and m those with both stats
_SPREAD = lambda x, xx: f"(m * {xx} - {x} * {x})"
POOLED_RAW = f"""rw AS (SELECT r.* EXCLUDE (n), r.n AS m, c.n FROM ({_RAW}) r JOIN (SELECT season, p, count(*) AS n FROM st GROUP BY season, p) c USING (season, p)), {pooled('rw', 'p, s1, s2', ['n', 'm', 'x', 'y', 'xx', 'yy', 'xy'])},
pr AS (SELECT scheme, p, s1, s2, CASE WHEN m > 0 AND {_SPREAD('x', 'xx')} > m * xx * 1e-9 AND {_SPREAD('y', 'yy')} > m * yy * 1e-9 THEN round(greatest({D(-1)}, least({D(1)}, (m * xy - x * y) / sqrt({_SPREAD('x', 'xx')} * {_SPREAD('y', 'yy')}))), 4) + 0.0 END AS r FROM t)"""
SQL["pooled_raw"] = f"WITH {ST}, {POOLED_RAW} SELECT scheme, p, s1, s2, r FROM pr"
_MEANS = ["n", *(f"{k}_{s}" for s in STATS for k in "kt")]
SQL["pooled_means"] = f"""WITH {ST}, ms AS (SELECT season, p, count(*) AS n, {', '.join(f'count({s}) AS k_{s}, sum({s}) AS t_{s}' for s in STATS)} FROM st GROUP BY season, p), {pooled('ms', 'p', _MEANS)}
SELECT scheme, p, round(n, 3) AS n_eff, {', '.join(f'CASE WHEN k_{s} > 0 THEN floor(t_{s} / k_{s} * 100 + 0.5) / 100 END AS avg_{s}' for s in STATS)} FROM t"""
SQL["pooled_report"] = f"""WITH {ST}, {POOLED_RAW}, pp AS ({SQL['pooled_pairs']}), x AS (SELECT pp.*, pr.r AS r_margin FROM pp LEFT JOIN pr ON pr.scheme = pp.scheme AND pr.p = pp.p AND least(s1, s2) = least(split_part(leg1, ' ', 3), split_part(leg2, ' ', 3)) AND greatest(s1, s2) = greatest(split_part(leg1, ' ', 3), split_part(leg2, ' ', 3)) WHERE split_part(leg1, ' ', 3) <> split_part(leg2, ' ', 3))
SELECT *, {GIVEN('"both"', 'hit1')} AS given1 FROM x WHERE coalesce(r, r_margin) IS NOT NULL"""
SQL["distinct_legs"] = f"WITH p2 AS ({SQL['entity_pairs']}), p3 AS ({SQL['entity_triples']}) SELECT leg1 AS leg FROM p2 UNION SELECT leg2 FROM p2 UNION SELECT leg1 FROM p3 UNION SELECT leg2 FROM p3 UNION SELECT leg3 FROM p3"
SQL["season_files"] = f"WITH {ST} SELECT season, p, count(*) AS n, CAST(sum(K) AS BIGINT) AS k FROM st GROUP BY season, p"
SQL["entity_documents"] = f"SELECT scheme, p, CAST(count(*) AS INT) AS n, min(leg1) AS first_leg, arg_max(leg2, leg1 || chr(1) || leg2) AS last_leg FROM ({SQL['pooled_pairs']}) GROUP BY scheme, p"
SQL["dyad_layout"] = f"""SELECT scheme, p1, p2, t, leg1, leg2, r_binary, r_margin, hit1, hit2, "both" FROM ({SQL['dyad_combos']})"""

SQL["upload_snapshots"] = f"WITH {UP} SELECT player, count(*) AS n, CAST(sum(games) AS BIGINT) AS games FROM en GROUP BY player"
SQL["upload_players"] = f"WITH {UP} SELECT player, CAST(count(*) AS INT) AS n, min(id) AS first_id, max(id) AS last_id FROM en GROUP BY player"
SQL["slate_rows"] = f"""WITH {BX}, sd AS (SELECT gid, side, team_id FROM (SELECT DISTINCT gid FROM bx), (VALUES ('home', 0), ('away', 1)) v(side, team_id)),
rk AS (SELECT gid, team_id, ord, player, row_number() OVER (PARTITION BY gid, team_id ORDER BY ord, player) - 1 AS pos FROM bx) SELECT gid AS game_id, side, CAST(pos AS INT) AS pos, ord, player FROM sd LEFT JOIN rk USING (gid, team_id)"""
SQL["backfill"] = f"WITH {BX} SELECT team_id, coalesce(CASE WHEN player % 3 = 0 THEN 'L' END, p_brand) AS hand, count(*) AS n FROM bx LEFT JOIN part ON p_partkey = player GROUP BY 1, 2"
_SIDE_STATUS = lambda n, back: f"CASE WHEN {n} >= 9 THEN 'confirmed' WHEN {back} >= 9 THEN 'projected' ELSE 'awaiting' END"
SQL["lineup_status"] = f"""WITH {QU}, x AS (SELECT {_SIDE_STATUS('n % 12', 'candidate_id % 12')} AS home, {_SIDE_STATUS('candidate_id % 11', 'n % 10')} AS away FROM q0)
SELECT home, away, CASE WHEN 'awaiting' IN (home, away) THEN 'awaiting' WHEN 'projected' IN (home, away) THEN 'projected' ELSE 'confirmed' END AS status, count(*) AS n FROM x GROUP BY 1, 2, 3"""
SQL["season_labels"] = f"WITH g AS (SELECT year(d) - CASE WHEN month(d) < 8 THEN 1 ELSE 0 END AS y FROM ({adapted_sql('games')})) SELECT y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, count(*) AS n FROM g GROUP BY 1"

_STAT = "CASE " + " ".join(f"WHEN regexp_matches(lower(marketName), '{p}') THEN '{n}'" for p, n, _ in _MARKETS["pitcher"]) + " END"
_OFFERED = "CASE stat " + " ".join(f"WHEN '{n}' THEN pts IN ({lines})" for _, n, lines in _MARKETS["pitcher"]) + " ELSE FALSE END"
_WORDS_OF_STATS = ["Strikeouts", "Earned Runs", "Walks", "Hits Allowed", "Pitching Outs", "Total Bases", "Home Runs", "RBIs", "Hits", "Runs", "Singles", "Doubles", "Stolen Bases", "3-Pointers Made", "3-Point Made", "Threes Made", "Points", "Rebounds", "Assists", "Steals", "Blocks", "Turnovers"]


def _less(name: str, suffix: str) -> str:
    forms = [suffix, f"replace({suffix}, ' O/U', '')", f"replace({suffix}, ' Milestones', '')"]
    return "CASE " + " ".join(f"WHEN length({f}) > 0 AND ends_with(lower({name}), lower({f})) THEN trim(left({name}, length({name}) - length({f})))" for f in forms) + f" ELSE {name} END"


_BEFORE = "CASE " + " ".join(f"WHEN strpos(market_, '{w}') > 1 THEN trim(left(market_, strpos(market_, '{w}') - 1))" for w in _WORDS_OF_STATS) + " ELSE market_ END"
SQL["market_texts"] = f"""WITH {MK}, x AS (SELECT *, {_STAT} AS stat, concat_ws(' ', player, CASE WHEN feed_pos % 5 = 1 THEN upper(marketName) ELSE marketName END, CASE WHEN feed_pos % 7 = 0 THEN subcategory END) AS market_,
CASE feed_pos % 6 WHEN 0 THEN marketName || ' O/U' WHEN 4 THEN marketName || ' Milestones' WHEN 2 THEN marketName END AS kind_ FROM se),
y AS (SELECT *, {_less('market_', 'kind_')} AS once FROM x), z AS (SELECT *, {_less('once', 'subcategory')} AS twice FROM y)
SELECT selectionId, stat, {_OFFERED} AS offered, dir AS direction,
coalesce(CASE feed_pos % 3 WHEN 0 THEN {D('pts')} WHEN 1 THEN {D('pts')} + 1 END, try_cast(nullif(regexp_extract(outcomeType, '([0-9]+)', 1), '') AS DOUBLE)) AS line, CASE WHEN twice <> market_ THEN twice ELSE {_BEFORE} END AS named FROM z"""
SQL["event_selections"] = f"WITH {MK} SELECT eventId, count(*) AS n FROM se WHERE marketId IN (SELECT marketId FROM se WHERE contains(subcategory, 'O/U')) GROUP BY eventId"
SQL["player_events"] = f"""WITH {MK}, pl AS (SELECT DISTINCT player, pa FROM lg), m AS (SELECT pl.player, eventId, row_number() OVER (PARTITION BY pl.player ORDER BY feed_pos) AS k FROM pl JOIN se ON {_NAME}) SELECT pl.player, eventId AS event_id FROM pl LEFT JOIN m ON m.player = pl.player AND k = 1"""
_NICK = lambda c: f"regexp_replace(lower(trim({c})), '^(north|south) ', '')"
SQL["team_events"] = f"""WITH f AS ({adapted_sql('fixtures')}), n AS (SELECT id, start_date, unnest([{_NICK('homeTeam')}, {_NICK('awayTeam')}, lower(homeShort), lower(awayShort)]) AS nick FROM f),
b AS (SELECT nick, id FROM (SELECT *, row_number() OVER (PARTITION BY nick ORDER BY start_date, id) AS k FROM n) WHERE k = 1), t AS (SELECT team, {_NICK('team')} AS nick FROM ({adapted_sql('teams')})) SELECT team, nick, id AS event_id FROM t LEFT JOIN b USING (nick)"""
_TEAM = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
_EVERY = lambda side: f"len(list_filter(string_split({side}, ' '), lambda w: NOT contains(gn, w))) = 0"
SQL["text_events"] = f"""WITH f AS (SELECT id, feed_pos, lower(coalesce(homeShort, '')) AS hs, lower(coalesce(awayShort, '')) AS aw, {_TEAM('homeTeam')} AS ht, {_TEAM('awayTeam')} AS wt FROM ({adapted_sql('fixtures')})),
c AS (SELECT game_id, {_TEAM('team')} AS tn, {_TEAM('game')} AS gn FROM ({adapted_sql('texts')})), c2 AS (SELECT *, list_filter(string_split(gn, ' '), lambda w: w NOT IN ('vs', 'at', 'v')) AS parts FROM c),
r AS (SELECT game_id, id, feed_pos, CASE WHEN tn <> '' AND (tn IN (hs, aw) OR ht <> '' AND (contains(ht, tn) OR contains(tn, ht)) OR wt <> '' AND (contains(wt, tn) OR contains(tn, wt))) THEN 1
WHEN gn <> '' AND len(parts) = 2 AND len(list_filter(parts, lambda w: length(w) > 4)) = 0 AND least(parts[1], parts[2]) = least(hs, aw) AND greatest(parts[1], parts[2]) = greatest(hs, aw) THEN 2 WHEN gn <> '' AND ht <> '' AND wt <> '' AND {_EVERY('ht')} AND {_EVERY('wt')} THEN 3 END AS rule FROM c2, f),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY rule, feed_pos, id) AS k FROM r WHERE rule IS NOT NULL) WHERE k = 1) SELECT c.game_id, id AS event_id, rule FROM c LEFT JOIN m USING (game_id)"""
SQL["feed_selections"] = f"WITH {MK} SELECT eventId, marketId, selectionId, feed_pos, CAST(pts AS DOUBLE) AS points, is_pitcher, is_batter, is_player FROM se"
_CAT = "CASE WHEN contains(leg, 'Strikeout') THEN 'SO' WHEN contains(leg, 'Earned Run') THEN 'ER' WHEN contains(leg, 'Walk') THEN 'BB' WHEN contains(leg, 'Hit') THEN 'H' WHEN contains(leg, 'Out') THEN 'OUTS' ELSE 'ZZZ' END"
_HELD = f"l0 AS (SELECT DISTINCT player, direction || ' ' || CAST(thr AS VARCHAR) || ' ' || stat AS leg FROM ({adapted_sql('legs')})), l AS (SELECT player, leg, row_number() OVER (PARTITION BY player ORDER BY {_CAT}, leg) AS k FROM l0)"
SQL["leg_pairs"] = f"WITH {_HELD} SELECT a.player, a.leg AS leg1, b.leg AS leg2 FROM l a JOIN l b ON a.player = b.player AND a.k < b.k"
SQL["leg_triples"] = f"WITH {_HELD} SELECT a.player, a.leg AS leg1, b.leg AS leg2, c.leg AS leg3 FROM l a JOIN l b ON a.player = b.player AND a.k < b.k JOIN l c ON b.player = c.player AND b.k < c.k"
SQL["price_requests"] = f"WITH {MK} SELECT DISTINCT eventId AS event_id, least(selectionId, o) AS a, greatest(selectionId, o) AS b FROM (SELECT *, 's' || CAST(feed_pos * 7 % 50 AS VARCHAR) AS o FROM se WHERE feed_pos % 9 <> 0)"
SQL["price_merge"] = f"""WITH {QD} SELECT candidate_id, r, american AS offered, CASE WHEN n % 3 <> 0 THEN round(pa * pb * decimal_ - 1, 9) END AS ev_frac, CASE WHEN n % 3 <> 0 THEN round(({_J} - {D(1)} / decimal_) * 100, 9) END AS edge_points,
CASE WHEN american IS NULL THEN 'not requested' WHEN n % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN 'leg1, leg2' ELSE 'not matched' END END AS price_reason FROM q"""
SQL["fair_value_kinds"] = f"""WITH {SN}, {_DEDUPE('DESC')}, {UP}, pr AS (SELECT player, stat || '|' || direction AS k, line, {_PROB('min(fv)')} AS prob FROM d2 GROUP BY player, stat, direction, line)
SELECT en.id, a.prob AS p_leg1, b.prob AS p_leg2, CASE (a.prob IS NOT NULL)::INT + (b.prob IS NOT NULL)::INT WHEN 2 THEN 'full_fv' WHEN 1 THEN 'hybrid' ELSE 'corr_only' END AS kind
FROM en LEFT JOIN pr a ON a.player = en.player AND a.k = k1 AND a.line = l1 LEFT JOIN pr b ON b.player = en.player AND b.k = k2 AND b.line = l2"""
_FOLD = "lower(trim(regexp_replace(strip_accents(coalesce(player, '')), '[^A-Za-z0-9]+', ' ', 'g')))"
SQL["name_sets"] = f"WITH {UP} SELECT player, {_FOLD} IN (SELECT {_FOLD} FROM ({adapted_sql('legs')})) AS matched FROM (SELECT DISTINCT player FROM en)"
_OTHER = f"CASE WHEN other > 0 THEN 1 + {D('other')} / 100 WHEN other < 0 THEN 1 + {D(100)} / -{D('other')} END"
SQL["parlay_factors"] = f"WITH {QD}, i AS (SELECT candidate_id, decimal_, coalesce(decimal_, 1) * ({_OTHER}) AS independent FROM q) SELECT candidate_id, independent, decimal_ / independent AS factor FROM i"
SQL["triple_verdicts"] = f"WITH {ATT} SELECT candidate_id, CASE WHEN total < 0 THEN 'SKIP' WHEN total > 10 AND n >= 20 AND sign(total) = sign(from_legs) THEN 'PLAY' WHEN total IS NOT NULL THEN 'MARGINAL' END AS verdict FROM att"
SQL["ev_page"] = f"WITH {QD} SELECT candidate_id, round(({_J} * decimal_ - 1) * 100, 6) AS ev, CASE WHEN n % 5 <> 0 THEN {D('n')} / 100 END AS p_value FROM q ORDER BY ev DESC NULLS LAST, coalesce(p_value, 1), candidate_id LIMIT 30 OFFSET 30"
SQL["entity_document"] = f"""WITH pp AS ({SQL['pooled_pairs']}) SELECT scheme, p, leg1, leg2, r FROM pp WHERE scheme = 'static' AND p = (SELECT max(p) FROM pp)"""
