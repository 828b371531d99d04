"""The queries of ``edges`` in DuckDB's SQL."""

from __future__ import annotations

from itertools import combinations

from ..sources.adapters import adapted_sql
from .oracle import _NAME, _SIDE, ALL_LU, ALL_ST, CURRENT, ENTITY_LEGS, ENTITY_SCHEMES, IN_SEASONS, LU, MK, QD, QU, SEASONS, SLOTS, SPAN, SQL, ST, UP, D, _normal, leg_name, schemes

_W = dict(zip(SEASONS, ENTITY_SCHEMES["static"]))
_WEIGHT = "CASE season " + " ".join(f"WHEN {s} THEN {D(w)}" for s, w in _W.items()) + " END"
_BLENDED = lambda own, w: f"CASE WHEN {own} IS NULL THEN base WHEN base IS NULL THEN {own} ELSE {w} * {own} + (1 - {w}) * base END"
_SHRUNK = f"""gp AS ({SQL['global_pairs']}), gb AS (SELECT leg1, leg2, sum({_WEIGHT} * r ORDER BY season) / sum(CASE WHEN r IS NOT NULL THEN {_WEIGHT} END ORDER BY season) AS base FROM gp WHERE season IN ({', '.join(map(str, SEASONS))}) GROUP BY leg1, leg2),
sp AS (SELECT p, leg1, leg2, n_eff, base, CASE WHEN n_eff < 5 THEN base ELSE {_BLENDED('r', '(n_eff / (n_eff + 50))')} END AS r FROM ({SQL['pooled_pairs']}) pp LEFT JOIN gb USING (leg1, leg2) WHERE scheme = 'static')"""
SQL["shrunk_pairs"] = f"WITH {_SHRUNK} SELECT p, leg1, leg2, n_eff, round(base, 9) AS base, round(r, 9) AS r FROM sp"
_TRIPLES = ", ".join("('" + "', '".join(leg_name(x) for x in c) + "')" for c in combinations(ENTITY_LEGS, 3))
SQL["shrunk_triples"] = f"""WITH {_SHRUNK} SELECT a.p, t.leg1, t.leg2, t.leg3, round((coalesce(a.r, 0) + coalesce(b.r, 0) + coalesce(c.r, 0)) / nullif((a.r IS NOT NULL)::INT + (b.r IS NOT NULL)::INT + (c.r IS NOT NULL)::INT, 0), 9) AS r
FROM (VALUES {_TRIPLES}) t(leg1, leg2, leg3) JOIN sp a ON a.leg1 = t.leg1 AND a.leg2 = t.leg2 JOIN sp b ON b.p = a.p AND b.leg1 = t.leg1 AND b.leg2 = t.leg3 JOIN sp c ON c.p = a.p AND c.leg1 = t.leg2 AND c.leg2 = t.leg3"""
SQL["lineup_share"] = f"SELECT season, count(*) AS n, count(*) FILTER (PA > 0 AND bo IS NOT NULL) AS k, count(*) FILTER (PA > 0 AND bo IS NOT NULL) / {D('count(*)')} AS share FROM {ALL_LU} GROUP BY season"
SQL["slot_pair_samples"] = f"WITH {SLOTS} SELECT slot1, slot2, count(*) AS games, {', '.join(f'count(*) FILTER (season = {s}) AS n_{s}' for s in SEASONS)} FROM dy WHERE {IN_SEASONS} GROUP BY slot1, slot2"
SQL["slot_samples"] = f"WITH {SLOTS}, g AS (SELECT season, gid, t, count(*) AS k FROM rw GROUP BY ALL) SELECT season, count(*) FILTER (k >= 2) AS team_games, CAST(sum(k * (k - 1)) AS BIGINT) AS dyads FROM g GROUP BY season"
SQL["dyad_candidates"] = f"""WITH lk AS ({SQL['dyad_lookup']}), dc AS (SELECT * FROM ({SQL['dyad_combos']}) WHERE scheme = 'static'), sb AS ({SQL['slot_baselines']}),
a AS (SELECT CASE WHEN swapped THEN p2 ELSE p1 END AS p1, CASE WHEN swapped THEN p1 ELSE p2 END AS p2, t, CASE WHEN swapped THEN slot2 ELSE slot1 END AS slot1, CASE WHEN swapped THEN slot1 ELSE slot2 END AS slot2 FROM lk WHERE n_total IS NOT NULL),
g AS (SELECT p1, p2, t, slot1, slot2, count(*) AS asked FROM a GROUP BY ALL),
x AS (SELECT g.*, dc.leg1, dc.leg2, dc.games, dc.r_binary AS own, sb.r_binary AS base, dc.r_margin AS mown, sb.r_margin AS mbase, sb.games IS NOT NULL AS known FROM g JOIN dc ON dc.p1 = g.p1 AND dc.p2 = g.p2 AND dc.t = g.t LEFT JOIN sb ON sb.slot1 = g.slot1 AND sb.slot2 = g.slot2 AND sb.leg1 = dc.leg1 AND sb.leg2 = dc.leg2)
SELECT p1, p2, t, slot1, slot2, leg1, leg2, asked, games, round(CASE WHEN NOT known OR games < 30 THEN coalesce(base, 0) ELSE {_BLENDED('own', '(CAST(games AS DOUBLE) / (games + 80))')} END, 9) AS r, round(CASE WHEN NOT known OR games < 30 THEN coalesce(mbase, 0) ELSE {_BLENDED('own', '(CAST(games AS DOUBLE) / (games + 80))').replace('own', 'mown').replace('base', 'mbase')} END, 9) AS r_margin, NOT known OR games < 30 AS fallback FROM x"""
SQL["ticket_picks"] = f"""WITH {UP}, n AS ({SQL['nearest_lines']}), s AS (SELECT DISTINCT player FROM ({adapted_sql('sheet')}) WHERE trim(player) <> '')
SELECT ticket, entry_id, n_games, try_cast(b.P_Value AS DOUBLE) AS p_value FROM n JOIN u0 ON u0.id = ticket JOIN u0 b ON b.id = entry_id WHERE drift = 0 AND n_games >= 25 AND try_cast(b.P_Value AS DOUBLE) <= 0.3 AND u0.Prop_1 IN ('Points', 'Assists') AND u0.Prop_2 IN ('Points', 'Assists') AND u0.Player_1 IN (SELECT player FROM s)"""
SQL["filtered_candidates"] = f"""WITH {QD}, x AS (SELECT candidate_id, n, status, 'T' || CAST(n % 5 AS VARCHAR) AS team, 'G' || CAST(candidate_id % 7 AS VARCHAR) AS game, CASE WHEN n % 25 >= 20 THEN 'high' WHEN n % 25 >= 5 THEN 'medium' WHEN n % 25 >= 1 THEN 'low' ELSE 'none' END AS confidence, round((pa * pb * decimal_ - 1) * 100, 6) AS ev_pct FROM q)
SELECT candidate_id, n, team, game, confidence, ev_pct FROM x WHERE n % 5 IN (0, 2, 3) AND candidate_id % 7 IN (1, 2, 3, 6) AND ev_pct >= 5 AND n >= 20 AND n % 2 = 0 AND confidence IN ('high', 'medium') AND status = 'confirmed'"""
SQL["featured_sets"] = f"SELECT candidate_id AS feed_pos, factor FROM ({SQL['parlay_factors']}) ORDER BY candidate_id LIMIT 6"

_MIX = lambda own, base, w: f"CASE WHEN {own} IS NULL THEN {base} WHEN {base} IS NULL THEN {own} ELSE {w} * {own} + (1 - {w}) * {base} END"
_THIN, _W80 = "(base IS NULL OR n < 30)", "(CAST(n AS DOUBLE) / (n + 80))"
SQL["resolved_modes"] = f"""WITH {QU}, x AS (SELECT candidate_id, n, r, pa - 0.5 AS m, CASE WHEN n % 3 <> 0 THEN pb - 0.5 END AS base FROM q0)
SELECT candidate_id, round(r, 9) + 0.0 AS r_player, round(m, 9) + 0.0 AS margin_player, {D(1)} AS weight_player, FALSE AS fallback_player, round(coalesce(base, 0), 9) + 0.0 AS r_global, round(coalesce(base / 2, 0), 9) + 0.0 AS margin_global, {D(0)} AS weight_global, base IS NULL AS fallback_global,
round(CASE WHEN {_THIN} THEN coalesce(base, 0) ELSE {_MIX('r', 'base', _W80)} END, 9) + 0.0 AS r_blended, round(CASE WHEN {_THIN} THEN coalesce(base / 2, 0) ELSE {_MIX('m', '(base / 2)', _W80)} END, 9) + 0.0 AS margin_blended, round(CASE WHEN {_THIN} THEN 0 ELSE {_W80} END, 9) + 0.0 AS weight_blended, {_THIN} AS fallback_blended FROM x"""
SQL["pooled_weights"] = f"""WITH {ST}, b AS (SELECT p, {', '.join(f'nullif(count(*) FILTER (season = {y}), 0) AS n_{i}' for i, y in enumerate(SEASONS))} FROM st WHERE {IN_SEASONS} GROUP BY p), s AS ({schemes(ENTITY_SCHEMES)}), w AS (SELECT p, scheme, n_0, n_1, n_2, n_3, {', '.join(_normal())} FROM b, s)
SELECT scheme, p, {', '.join(f'CASE WHEN n_{i} IS NOT NULL THEN round(v{i}, 4) END AS weight_{i}' for i in SPAN)} FROM w"""
SQL["dyad_summary"] = f"""SELECT p1, p2, t, leg1, leg2, games, CAST(floor("both" / 100 * games + 0.5) AS BIGINT) AS both_games FROM ({SQL['dyad_combos']}) WHERE scheme = 'unweighted'"""
_KEY = lambda c: f"lower(trim(regexp_replace(strip_accents({c}), '[^A-Za-z0-9]+', ' ', 'g')))"
SQL["folded_dyads"] = f"""WITH me AS (SELECT {_KEY('p1')} AS k1, {_KEY('p2')} AS k2, {_KEY('t')} AS kt, n_total FROM ({SQL['dyad_meta']})), {LU}, tn AS (SELECT DISTINCT gid, t, bo AS slot, p AS player FROM lu WHERE season = {CURRENT}),
pr AS (SELECT replace(a.player, 'a', 'à') AS p1, upper(b.player) AS p2, lower(a.t) AS t, count(*) AS asked FROM tn a JOIN tn b ON a.gid = b.gid AND a.t = b.t AND (a.slot, a.player) < (b.slot, b.player) GROUP BY 1, 2, 3)
SELECT pr.p1, pr.p2, pr.t, asked, o.n_total IS NULL AND r.n_total IS NOT NULL AS swapped, coalesce(o.n_total, r.n_total) AS n_total FROM pr LEFT JOIN me o ON o.k1 = {_KEY('pr.p1')} AND o.k2 = {_KEY('pr.p2')} AND o.kt = {_KEY('pr.t')} LEFT JOIN me r ON r.k1 = {_KEY('pr.p2')} AND r.k2 = {_KEY('pr.p1')} AND r.kt = {_KEY('pr.t')}"""
SQL["team_funnel"] = f"""WITH {QU} SELECT CASE WHEN status = 'awaiting' THEN 'game awaiting' WHEN n % 5 NOT IN (1, 4) THEN 'other team' WHEN n < 30 OR abs(coalesce(r, 0)) < 0.05 THEN 'below threshold' ELSE 'with data' END AS reason, count(*) AS n FROM q0 GROUP BY 1"""
SQL["pair_funnel"] = f"""WITH {QD}, x AS (SELECT status, CAST(n AS VARCHAR) || '_' || CAST(candidate_id % 7 AS VARCHAR) AS k, decimal_, (pa * pb * decimal_ - 1) * 100 AS ev FROM q)
SELECT status, count(*) AS candidates, count(DISTINCT k) AS emitted, count(DISTINCT k) FILTER (decimal_ IS NOT NULL) AS priced, count(DISTINCT k) FILTER (ev / 100 >= {D(5)} / 100) AS surviving FROM x GROUP BY status"""
SQL["upload_folded"] = f"""WITH {UP}, v AS (SELECT id, CASE WHEN id % 2 = 0 THEN upper(player) ELSE replace(player, 'o', 'ö') END AS name FROM en) SELECT {_KEY('name')} AS key, count(DISTINCT name) AS names, CAST(count(*) AS INT) AS n, min(id) AS first_id, max(id) AS last_id FROM v GROUP BY 1"""
SQL["playable_games"] = f"""WITH f AS ({adapted_sql('feed')}), x AS (SELECT *, CASE WHEN day LIKE '%/%' THEN CAST(strptime(day, '%m/%d/%Y') AS DATE) WHEN day <> 'tba' THEN CAST(substr(day, 1, 10) AS DATE) END AS d FROM f WHERE coalesce(game_type, '') NOT IN ('S', 'E') AND (tags = 'SGP' OR tags LIKE '%,SGP'))
SELECT CAST(d AS VARCHAR) AS d, CAST(d - 1 AS VARCHAR) AS eve, game_type, count(*) AS n FROM x GROUP BY ALL"""
SQL["short_stats"] = f"""WITH l AS ({adapted_sql('legs')}), x AS (SELECT leg_id, direction, CAST(thr AS DOUBLE) AS threshold, stat, CASE stat WHEN 'Hits' THEN 'H' WHEN 'Runs' THEN 'R' WHEN 'RBIs' THEN 'RBI' WHEN 'Home Runs' THEN 'HR' WHEN 'Total Bases' THEN 'TB' WHEN 'Walks' THEN 'BB' WHEN 'Stolen Bases' THEN 'SB' WHEN 'Strikeouts' THEN 'SO' END AS code FROM l)
SELECT *, CASE WHEN code IS NULL THEN 'unknown stat' WHEN code = 'SO' THEN 'no priced market' END AS skip FROM x"""
SQL["slim_starts"] = f"SELECT season AS y, count(*) AS n, count(*) FILTER (gid % 3 <> 0) AS n_i, CAST(sum(ER) AS DOUBLE) AS e FROM {ALL_ST} GROUP BY season"
