"""The same queries in DuckDB's SQL, written from the definitions: every row meets every combo, no shared counts."""

from __future__ import annotations

from itertools import combinations

from ..sources.adapters import adapted_sql

# What the queries ask for, said again here: nothing but the driver tables' SELECTs is shared with the library.
SEASONS, CURRENT = [1998, 1999, 2000, 2001], 2001
STATS = ["K", "ER", "BB", "H", "OUTS"]
ENTITY_LEGS = [("Over", 25.5, "K"), ("Under", 15.5, "K"), ("Over", 5.5, "ER"), ("Under", 3.5, "ER"), ("Over", 4.5, "BB"), ("Over", 3.5, "H"), ("Under", 2.5, "H"), ("Over", 12.5, "OUTS")]
LINEUP_LEGS = [("Over", 25.5, "H"), ("Over", 5.5, "R"), ("Over", 4.5, "RBI"), ("Under", 3.5, "TB"), ("Over", 35.5, "H"), ("Under", 10.5, "H"), ("Over", 7.5, "R"), ("Under", 2.5, "R"), ("Over", 6.5, "RBI"), ("Over", 5.5, "TB"), ("Over", 40.5, "HRR"), ("Under", 20.5, "HRR")]
LINEUP_STATS = ["H", "R", "RBI", "TB", "HRR"]
LINEUP_COMBOS = [(a, b) for a in range(12) for b in range(12) if a <= b]
# The weights of the seasons, oldest first, by scheme.
ENTITY_SCHEMES = {"dyn_1_3": (0.20, 0.25, 0.40, 0.15), "dyn_4_8": (0.15, 0.20, 0.35, 0.30), "dyn_9_15": (0.10, 0.15, 0.30, 0.45), "dyn_16plus": (0.08, 0.12, 0.25, 0.55), "static": (0.15, 0.20, 0.30, 0.35), "unweighted": (1.0, 1.0, 1.0, 1.0)}
DYAD_SCHEMES = {"dyn_1_10": (0.20, 0.25, 0.45, 0.10), "dyn_11_25": (0.15, 0.20, 0.35, 0.30), "dyn_26_60": (0.10, 0.15, 0.30, 0.45), "dyn_61plus": (0.08, 0.12, 0.25, 0.55), "static": (0.15, 0.20, 0.30, 0.35), "unweighted": (1.0, 1.0, 1.0, 1.0)}

SPAN = range(len(SEASONS))


def combos_of(legs: list, size: int) -> list[tuple]:
    return [(i, *c) for i, c in enumerate(combinations(range(len(legs)), size))]


def leg_name(leg: tuple) -> str:
    return " ".join(map(str, leg))


def D(x: object) -> str:
    return f"CAST({x} AS DOUBLE)"


def ratio(k: str, n: str, unit: int, factor: int = 1) -> str:
    return f"CASE WHEN {n} > 0 THEN ((CAST({k} AS BIGINT) * {2 * unit * factor} + CAST({n} AS BIGINT)) // (CAST({n} AS BIGINT) * 2)) / {D(unit)} END"


def percent(k: str, n: str) -> str:
    return ratio(k, n, 10, 100)


def phi(n: str, n1: str, n2: str, n11: str) -> str:
    a, b, c, d = D(n), D(n1), D(n2), D(n11)
    return f"CASE WHEN {b} > 0 AND {b} < {a} AND {c} > 0 AND {c} < {a} THEN greatest({D(-1)}, least({D(1)}, ({a} * {d} - {b} * {c}) / sqrt(({b} * ({a} - {b})) * ({c} * ({a} - {c}))))) END"


def pearson(n: str, x: str, y: str, xx: str, yy: str, xy: str) -> str:
    n, x, y, xx, yy, xy = map(D, (n, x, y, xx, yy, xy))
    vx, vy = f"({n} * {xx} - {x} * {x})", f"({n} * {yy} - {y} * {y})"
    return f"CASE WHEN {n} > 1 AND {vx} > 0 AND {vy} > 0 THEN greatest({D(-1)}, least({D(1)}, ({n} * {xy} - {x} * {y}) / sqrt({vx} * {vy}))) END"


def dot(names: list[str], weights: list[str]) -> str:
    out = D(0)
    for n, w in zip(names, weights):
        out = f"({out} + coalesce({D(n)}, {D(0)}) * {w})"
    return out


def hit(value: str, leg: tuple) -> str:
    return f"CASE WHEN {value} {'>' if leg[0] == 'Over' else '<'} {leg[1]} THEN 1 ELSE 0 END"


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


ALL_ST, ALL_LU = f"({adapted_sql('starts')})", f"({adapted_sql('lineups')})"
ST = f"st AS (SELECT * FROM {ALL_ST} WHERE upper(trim(flag)) = 'YES' AND ip > 0)"
LU = f"lu AS (SELECT *, H + R + RBI AS HRR FROM {ALL_LU} WHERE PA > 0 AND bo IS NOT NULL)"
IN_SEASONS = f"season IN ({', '.join(map(str, SEASONS))})"
NAMES = "[" + ", ".join(f"'{leg_name(x)}'" for x in ENTITY_LEGS) + "]"
STAT = "[" + ", ".join(f"'{x[2]}'" for x in ENTITY_LEGS) + "]"
HITS = f"h AS (SELECT season, p, [{', '.join(hit(x[2], x) for x in ENTITY_LEGS)}] AS h FROM st)"
PAIRS = f"co(idx, a, b) AS ({values(combos_of(ENTITY_LEGS, 2))})"
COUNTS = f"""{ST}, {HITS}, {PAIRS}, pc AS (SELECT season, p, a, b, count(*) AS n, CAST(sum(h[a + 1]) AS BIGINT) AS n1, CAST(sum(h[b + 1]) AS BIGINT) AS n2, CAST(sum(h[a + 1] * h[b + 1]) AS BIGINT) AS n11 FROM h, co GROUP BY ALL)"""
_RAW = " UNION ALL ".join(
    f"SELECT season, p, '{a}' AS s1, '{b}' AS s2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
    + ", ".join(f"sum({e}) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS {k}" for k, e in (("x", a), ("y", b), ("xx", f"{a} * {a}"), ("yy", f"{b} * {b}"), ("xy", f"{a} * {b}")))
    + " FROM st GROUP BY season, p"
    for a, b in combinations(STATS, 2)
)
RAW = f"raw AS (SELECT season, p, s1, s2, n, round({pearson('n', 'x', 'y', 'xx', 'yy', 'xy')}, 4) + 0.0 AS r FROM ({_RAW}))"
GIVEN = lambda both, hit: percent(f"round({both} * 10)", f"round({hit} * 10)")

SQL: dict[str, str] = {}
SQL["season_manifest"] = f'WITH {ST} SELECT season, count(*) AS "rows", CAST(min(d) AS VARCHAR) AS "first", CAST(max(d) AS VARCHAR) AS "last" FROM st GROUP BY season'
SQL["starter_share"] = f"WITH st AS {ALL_ST} SELECT season, n, k, k / {D('n')} AS share FROM (SELECT season, count(*) FILTER (ip > 0) AS n, count(*) FILTER (upper(trim(flag)) = 'YES' AND ip > 0) AS k FROM st GROUP BY season)"
SQL["corpus_summary"] = f'WITH {LU} SELECT season, count(*) AS "rows", count(DISTINCT gid) AS games, count(DISTINCT (gid, t)) AS team_games FROM lu GROUP BY season'
SQL["entity_means"] = f"WITH {ST} SELECT season, p, count(*) AS n, {', '.join(ratio(f'sum({s})', f'count({s})', 100) + f' AS avg_{s}' for s in STATS)} FROM st GROUP BY season, p"
SQL["raw_correlations"] = f"WITH {ST}, {RAW} SELECT season, p, s1, s2, CAST(n AS BIGINT) AS n, r FROM raw"
SQL["entity_pairs"] = f"""WITH {COUNTS}, {RAW}, x AS (SELECT pc.season, pc.p, {NAMES}[a + 1] AS leg1, {NAMES}[b + 1] AS leg2, pc.n, round({phi('pc.n', 'n1', 'n2', 'n11')}, 4) + 0.0 AS r, raw.r AS r_margin,
  {percent('n1', 'pc.n')} AS hit1, {percent('n2', 'pc.n')} AS hit2, {percent('n11', 'pc.n')} AS both_
  FROM pc LEFT JOIN raw ON raw.season = pc.season AND raw.p = pc.p AND least(s1, s2) = least({STAT}[a + 1], {STAT}[b + 1]) AND greatest(s1, s2) = greatest({STAT}[a + 1], {STAT}[b + 1]) WHERE {STAT}[a + 1] <> {STAT}[b + 1])
SELECT season, p, leg1, leg2, n, r, r_margin, hit1, hit2, both_ AS "both", {GIVEN('both_', 'hit1')} AS given1 FROM x WHERE coalesce(r, r_margin) IS NOT NULL"""
_T = {(i, j): phi("n", f"n{i}", f"n{j}", f"n{i}{j}") for i, j in ((1, 2), (1, 3), (2, 3))}
SQL["entity_triples"] = f"""WITH {ST}, {HITS}, co(idx, a, b, c) AS ({values(combos_of(ENTITY_LEGS, 3))}),
tc AS (SELECT season, p, a, b, c, count(*) AS n, sum(h[a+1]) AS n1, sum(h[b+1]) AS n2, sum(h[c+1]) AS n3, sum(h[a+1]*h[b+1]) AS n12, sum(h[a+1]*h[c+1]) AS n13, sum(h[b+1]*h[c+1]) AS n23, sum(h[a+1]*h[b+1]*h[c+1]) AS n123, sum((1-h[a+1])*(1-h[b+1])*(1-h[c+1])) AS n000 FROM h, co GROUP BY ALL),
x AS (SELECT season, p, {NAMES}[a+1] AS leg1, {NAMES}[b+1] AS leg2, {NAMES}[c+1] AS leg3, n, {', '.join(f'round({v}, 4) + 0.0 AS r{i}{j}' for (i, j), v in _T.items())}, {', '.join(percent(f'n{i}', 'n') + f' AS hit{i}' for i in (1, 2, 3))}, {percent('n123', 'n')} AS all3, {percent('n000', 'n')} AS none3 FROM tc)
SELECT *, round(({D(0)} + coalesce(r12, 0) + coalesce(r13, 0) + coalesce(r23, 0)) / ((r12 IS NOT NULL)::INT + (r13 IS NOT NULL)::INT + (r23 IS NOT NULL)::INT), 4) + 0.0 AS avg_r FROM x WHERE coalesce(r12, r13, r23) IS NOT NULL"""
SQL["global_pairs"] = f"""WITH {COUNTS}, e AS (SELECT *, n1 / {D('n')} AS u, n2 / {D('n')} AS v FROM pc),
g AS (SELECT season, a, b, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n2) AS BIGINT) AS n2, CAST(sum(n11) AS BIGINT) AS n11, count(*) AS k, sum(u) AS x, sum(v) AS y, sum(u*u) AS xx, sum(v*v) AS yy, sum(u*v) AS xy, min(u) < max(u) AND min(v) < max(v) AS ok FROM e GROUP BY season, a, b),
o AS (SELECT season, {NAMES}[a+1] AS leg1, {NAMES}[b+1] AS leg2, n, k AS entities, round({phi('n', 'n1', 'n2', 'n11')}, 4) + 0.0 AS r, CASE WHEN ok THEN round({pearson('k', 'x', 'y', 'xx', 'yy', 'xy')}, 4) + 0.0 END AS r_avg, {percent('n1', 'n')} AS hit1, {percent('n2', 'n')} AS hit2, {percent('n11', 'n')} AS both_ FROM g)
SELECT season, leg1, leg2, n, entities, r, r_avg, hit1, hit2, both_ AS "both", round(100 - hit1 - hit2 + both_, 1) AS neither, {GIVEN('both_', 'hit1')} AS given1, {GIVEN('both_', 'hit2')} AS given2 FROM o"""


def by_season(table: str, keys: str, sums: list[str]) -> str:
    return f"SELECT {keys}, " + ", ".join(f"CAST(sum({k}) FILTER (season = {s}) AS BIGINT) AS {k}_{i}" for k in sums for i, s in enumerate(SEASONS)) + f" FROM {table} GROUP BY {keys}"


def schemes(held: dict) -> str:
    return f"SELECT scheme, {', '.join(D(f'w{i}') + f' AS w{i}' for i in SPAN)}, pin FROM ({values([(k, *v, str(k != 'unweighted').upper()) for k, v in held.items()])}) s(scheme, w0, w1, w2, w3, pin)".replace("'TRUE'", "TRUE").replace("'FALSE'", "FALSE")


def _normal() -> list[str]:
    on = [f"(CASE WHEN n_{i} IS NOT NULL THEN {D(1)} ELSE {D(0)} END)" for i in SPAN]
    w = [f"w{i}" for i in SPAN]
    past, n_past = dot(on[:-1], w[:-1]), f"({on[0]} + {on[1]} + {on[2]})"
    total, n_all = f"({past} + {on[3]} * w3)", f"({n_past} + {on[3]})"
    pinned, rest = "(pin AND n_3 IS NOT NULL)", f"({D(1)} - w3)"
    plain = lambda i: f"CASE WHEN {total} > 0 THEN w{i} / {total} ELSE {D(1)} / {n_all} END"
    out = [f"CASE WHEN n_{i} IS NULL THEN {D(0)} WHEN {pinned} THEN CASE WHEN {past} > 0 THEN w{i} * ({rest} / {past}) ELSE {rest} / {n_past} END ELSE {plain(i)} END AS v{i}" for i in (0, 1, 2)]
    return [*out, f"CASE WHEN n_3 IS NULL THEN {D(0)} WHEN {n_past} = 0 THEN {D(1)} WHEN {pinned} THEN w3 ELSE {plain(3)} END AS v3"]


_SUMS = ["n", "n1", "n2", "n11"]
SQL["pooled_pairs"] = f"""WITH {COUNTS}, b AS ({by_season('pc', 'p, a, b', _SUMS)}), s AS ({schemes(ENTITY_SCHEMES)}), w AS (SELECT b.*, scheme, {', '.join(_normal())} FROM b, s),
t AS (SELECT scheme, p, a, b, {', '.join(dot([f'{k}_{i}' for i in SPAN], [f'v{i}' for i in SPAN]) + f' AS {k}' for k in _SUMS)} FROM w)
SELECT scheme, p, {NAMES}[a+1] AS leg1, {NAMES}[b+1] AS leg2, round(n, 3) AS n_eff, round({phi('n', 'n1', 'n2', 'n11')}, 4) + 0.0 AS r, round(n1 * 100 / n, 1) AS hit1, round(n2 * 100 / n, 1) AS hit2, round(n11 * 100 / n, 1) AS "both" FROM t"""
SQL["entity_seasons"] = f"""WITH {ST}, n AS (SELECT p, {', '.join(f'count(*) FILTER (season = {s}) AS n_{s}' for s in SEASONS)} FROM st GROUP BY p)
SELECT *, {' + '.join(f'(n_{s} > 0)::INT' for s in SEASONS)} AS n_years, CASE WHEN n_{CURRENT} <= 3 THEN 'dyn_1_3' WHEN n_{CURRENT} <= 8 THEN 'dyn_4_8' WHEN n_{CURRENT} <= 15 THEN 'dyn_9_15' ELSE 'dyn_16plus' END AS bucket FROM n"""

ROWS = f"{LU}, rw AS (SELECT *, row_number() OVER () AS rid FROM lu)"
DY = f"{ROWS}, dy AS MATERIALIZED (SELECT a.season, a.t, a.p AS p1, b.p AS p2, a.bo AS slot1, b.bo AS slot2, {', '.join(f'a.{s} AS x_{s}, b.{s} AS y_{s}' for s in LINEUP_STATS)} FROM rw a JOIN rw b ON a.season = b.season AND a.gid = b.gid AND a.t = b.t AND a.rid <> b.rid WHERE a.{IN_SEASONS})"
SLOTS = f"{LU}, rw AS (SELECT season, gid, t, bo, {', '.join(f'CAST(sum({s}) AS BIGINT) AS {s}' for s in LINEUP_STATS)} FROM lu WHERE bo BETWEEN 1 AND 9 GROUP BY ALL), dy AS MATERIALIZED (SELECT a.season, a.bo AS slot1, b.bo AS slot2, 'all' AS pool, {', '.join(f'a.{s} AS x_{s}, b.{s} AS y_{s}' for s in LINEUP_STATS)} FROM rw a JOIN rw b ON a.season = b.season AND a.gid = b.gid AND a.t = b.t AND a.bo <> b.bo)"
_ALL = ["n", "n1", "n2", "n11", "x", "y", "xx", "yy", "xy"]


def _moments(keys: str) -> str:
    parts = []
    for a, b in LINEUP_COMBOS:
        la, lb = LINEUP_LEGS[a], LINEUP_LEGS[b]
        x, y = f"x_{la[2]}", f"y_{lb[2]}"
        parts.append(f"SELECT {keys}, season, '{leg_name(la)}' AS leg1, '{leg_name(lb)}' AS leg2, count(*) AS n, sum({hit(x, la)}) AS n1, sum({hit(y, lb)}) AS n2, sum(({hit(x, la)}) * ({hit(y, lb)})) AS n11, sum({x}) AS x, sum({y}) AS y, sum({x}*{x}) AS xx, sum({y}*{y}) AS yy, sum({x}*{y}) AS xy FROM dy GROUP BY {keys}, season")
    return " UNION ALL ".join(parts)


def weighted(base: str, keys: str, held: dict, keep: str = "TRUE", scheme: bool = False) -> str:
    games = " + ".join(f"coalesce(n_{i}, 0)" for i in SPAN)
    return f"""WITH {base}, m AS ({_moments(keys)}), b AS ({by_season('m', f'{keys}, leg1, leg2', _ALL)}), s AS ({schemes(held)}),
t AS (SELECT scheme, {keys}, leg1, leg2, CAST({games} AS BIGINT) AS games, coalesce(n_3, 0) AS cur, {', '.join(dot([f'{k}_{i}' for i in SPAN], [f'w{i}' for i in SPAN]) + f' AS {k}' for k in _ALL)} FROM b, s),
o AS (SELECT {'scheme, ' if scheme else ''}{keys}, leg1, leg2, games, round({phi('n', 'n1', 'n2', 'n11')}, 4) + 0.0 AS r_binary, round({pearson('n', 'x', 'y', 'xx', 'yy', 'xy')}, 4) + 0.0 AS r_margin, round(n1 * 100 / n, 1) AS hit1, round(n2 * 100 / n, 1) AS hit2, round(n11 * 100 / n, 1) AS "both", round((n - n1 - n2 + n11) * 100 / n, 1) AS neither FROM t WHERE {keep})
SELECT * FROM o WHERE coalesce(r_binary, r_margin) IS NOT NULL"""


_STATIC = {"static": DYAD_SCHEMES["static"]}
_PASS = "CASE WHEN {cur} >= 10 THEN {n} >= 20 ELSE {n} >= 30 END"
SQL["slot_baselines"] = weighted(SLOTS, "slot1, slot2", _STATIC)
SQL["combo_floors"] = weighted(SLOTS, "pool", _STATIC)
SQL["dyad_combos"] = weighted(DY, "p1, p2, t", DYAD_SCHEMES, _PASS.format(cur="cur", n="games"), scheme=True)


def _mode(value: str) -> str:
    return f"(SELECT p1, p2, t, v FROM (SELECT p1, p2, t, {value} AS v, row_number() OVER (PARTITION BY p1, p2, t ORDER BY count(*) DESC, {value}) AS k FROM dy GROUP BY p1, p2, t, {value}) WHERE k = 1)"


META = f"""{DY}, bs AS (SELECT p1, p2, t, count(*) AS n_total, count(*) FILTER (season = {CURRENT}) AS n_cur, CAST(sum(abs(slot1 - slot2)) AS BIGINT) AS gaps, count(*) FILTER (abs(slot1 - slot2) = 1) AS adjacent FROM dy GROUP BY ALL),
us AS (SELECT p1, p2, t, slot1 || '_' || slot2 AS slots, count(*) AS k FROM dy GROUP BY ALL), tp AS (SELECT *, row_number() OVER (PARTITION BY p1, p2, t ORDER BY k DESC, slots) AS rk, count(*) OVER (PARTITION BY p1, p2, t) AS kinds FROM us),
me AS (SELECT bs.*, g.v AS gap_mode, a.v AS was1, b.v AS was2, tp.slots AS top_slots, tp.k AS top_n, kinds FROM bs JOIN {_mode('abs(slot1 - slot2)')} g USING (p1, p2, t) JOIN {_mode('slot1')} a USING (p1, p2, t) JOIN {_mode('slot2')} b USING (p1, p2, t) JOIN tp ON tp.p1 = bs.p1 AND tp.p2 = bs.p2 AND tp.t = bs.t AND rk = 1 WHERE {_PASS.format(cur='n_cur', n='n_total')})"""
SQL["dyad_meta"] = f"""WITH {META} SELECT p1, p2, t, n_total, n_cur, gaps / {D('n_total')} AS gap_mean, gap_mode, adjacent / {D('n_total')} AS adjacency, was1 AS slot1, was2 AS slot2, CAST(kinds AS INT) AS slot_usage, top_slots, top_n,
CASE WHEN n_cur <= 10 THEN 'dyn_1_10' WHEN n_cur <= 25 THEN 'dyn_11_25' WHEN n_cur <= 60 THEN 'dyn_26_60' ELSE 'dyn_61plus' END AS bucket FROM me"""
SQL["dyad_lookup"] = f"""WITH {META}, tn AS (SELECT DISTINCT gid, t, bo AS slot, p AS player FROM lu WHERE season = {CURRENT}), pr AS (SELECT a.gid, a.t, a.player AS p1, b.player AS p2, a.slot AS slot1, b.slot AS slot2 FROM tn a JOIN tn b ON a.gid = b.gid AND a.t = b.t AND (a.slot, a.player) < (b.slot, b.player)),
x AS (SELECT pr.*, coalesce(o.n_total, r.n_total) AS n_total, o.n_total IS NULL AND r.n_total IS NOT NULL AS swapped, coalesce(o.was1, r.was1) AS was1, coalesce(o.was2, r.was2) AS was2, coalesce(CASE WHEN o.n_total IS NOT NULL THEN uo.k WHEN r.n_total IS NOT NULL THEN ur.k END, 0) AS n_here
FROM pr LEFT JOIN me o ON o.p1 = pr.p1 AND o.p2 = pr.p2 AND o.t = pr.t LEFT JOIN me r ON r.p1 = pr.p2 AND r.p2 = pr.p1 AND r.t = pr.t
LEFT JOIN us uo ON uo.p1 = pr.p1 AND uo.p2 = pr.p2 AND uo.t = pr.t AND uo.slots = pr.slot1 || '_' || pr.slot2 LEFT JOIN us ur ON ur.p1 = pr.p2 AND ur.p2 = pr.p1 AND ur.t = pr.t AND ur.slots = pr.slot1 || '_' || pr.slot2)
SELECT gid, t, p1, p2, slot1, slot2, swapped, n_total, n_here, CASE WHEN n_here >= 20 THEN 'high' WHEN n_here >= 5 THEN 'medium' WHEN n_here >= 1 THEN 'low' ELSE 'none' END AS confidence,
CASE WHEN was1 IS NULL OR was2 IS NULL THEN 'different' WHEN slot1 = was1 AND slot2 = was2 OR slot1 = was2 AND slot2 = was1 THEN 'same' WHEN abs(slot1 - slot2) < abs(was1 - was2) THEN 'tighter' WHEN abs(slot1 - slot2) > abs(was1 - was2) THEN 'wider' ELSE 'different' END AS shift FROM x"""

QU = f"q0 AS ({adapted_sql('quotes')})"
_PROB = lambda a: f"CASE WHEN {a} > 0 THEN {D(100)} / ({D(a)} + 100) WHEN {a} < 0 THEN -{D(a)} / (-{D(a)} + 100) END"
_DEC = "CASE WHEN american > 0 THEN 1 + CAST(american AS DOUBLE) / 100 WHEN american < 0 THEN 1 + CAST(100 AS DOUBLE) / -CAST(american AS DOUBLE) END"
_FAIR = lambda p: f"CAST(CASE WHEN {p} > 0 AND {p} < 0.5 THEN floor((1 - {p}) * 100 / {p} + 0.5) WHEN {p} >= 0.5 AND {p} < 1 THEN -floor({p} * 100 / (1 - {p}) + 0.5) END AS BIGINT)"


def novig(over: str, under: str, direction: str) -> str:
    fair = f"(({_PROB(over)}) / (({_PROB(over)}) + ({_PROB(under)})))"
    return f"CASE WHEN {fair} >= 0.02 AND {fair} <= 0.98 THEN CASE WHEN {direction} = 'Over' THEN {fair} ELSE 1 - {fair} END END"


QD = f"{QU}, q AS (SELECT *, {_PROB('american')} AS prob, {_DEC} AS decimal_ FROM q0)"
SQL["odds_scalars"] = f"""WITH {QD} SELECT candidate_id, prob, decimal_ AS "decimal", {_FAIR('pa')} AS fair, CAST(CASE WHEN decimal_ >= 2 THEN floor((decimal_ - 1) * 100 + 0.5) WHEN decimal_ > 1 THEN floor({D(-100)} / (decimal_ - 1) + 0.5) END AS BIGINT) AS back, {novig('american', 'other', 'direction1')} AS novig,
(pa * pb * decimal_ - 1) * 100 AS ev, CASE WHEN decimal_ > 1 THEN greatest({D(0)}, (pa * decimal_ - 1) / (decimal_ - 1) * 0.25) * 100 END AS qk, (pa - {D(1)} / decimal_) * 100 AS edge, coalesce(decimal_, 1) * {D(2)} AS indep FROM q"""
_J = "CASE WHEN coalesce(r, 0) >= 0 THEN pa * pb + coalesce(r, 0) * (least(pa, pb) - pa * pb) ELSE pa * pb + coalesce(r, 0) * (pa * pb - greatest(CAST(0 AS DOUBLE), pa + pb - 1)) END"


def inverse(j: str) -> tuple[str, str]:
    hi, lo, ab = "least(pa, pb)", "greatest(CAST(0 AS DOUBLE), pa + pb - 1)", "(pa * pb)"
    r = f"CASE WHEN {j} IS NULL THEN NULL WHEN {hi} - {lo} <= 1e-12 THEN {D(0)} WHEN {j} >= {hi} THEN {D(1)} WHEN {j} <= {lo} THEN {D(-1)} WHEN {j} > {ab} AND {hi} - {ab} > 1e-12 THEN ({j} - {ab}) / ({hi} - {ab}) WHEN {j} < {ab} AND {ab} - {lo} > 1e-12 THEN ({j} - {ab}) / ({ab} - {lo}) ELSE {D(0)} END"
    c = f"CASE WHEN {j} IS NULL THEN NULL WHEN {hi} - {lo} <= 1e-12 THEN 'degenerate' WHEN {j} >= {hi} THEN CASE WHEN {j} > {hi} + 1e-9 THEN 'ceiling' END WHEN {j} <= {lo} THEN CASE WHEN {j} < {lo} - 1e-9 THEN 'floor' END WHEN {j} > {ab} AND {hi} - {ab} <= 1e-12 OR {j} < {ab} AND {ab} - {lo} <= 1e-12 THEN 'degenerate' END"
    return r, c


_OFFER = "(CAST(1 AS DOUBLE) / decimal_)"
ATT = f"{QD}, a0 AS (SELECT *, {_J} AS j FROM q), att AS (SELECT *, CASE WHEN decimal_ > 1 THEN round((j * decimal_ - 1) * 100, 9) END AS total, CASE WHEN decimal_ > 1 THEN round((pa * pb * decimal_ - 1) * 100, 9) END AS from_legs, CASE WHEN decimal_ > 1 THEN round((j - pa * pb) * decimal_ * 100, 9) END AS from_corr, CASE WHEN decimal_ > 1 THEN round(coalesce(r, 0) - ({inverse(_OFFER)[0]}), 9) END AS r_gap, CASE WHEN decimal_ > 1 THEN {inverse(_OFFER)[1]} END AS offer_clamp FROM a0)"
_KEEP = lambda x: f"least(greatest({x}, CAST(0.001 AS DOUBLE)), CAST(0.999 AS DOUBLE))"
_PHI = _KEEP(f"coalesce(r, 0) * sqrt({_KEEP('pa')} * (1 - {_KEEP('pa')}) * {_KEEP('pb')} * (1 - {_KEEP('pb')})) + {_KEEP('pa')} * {_KEEP('pb')}")
SQL["joint_scalars"] = f"""WITH {ATT}, f AS (SELECT *, {_PHI} AS phi FROM att) SELECT candidate_id, j, round({inverse('j')[0]}, 9) AS r_back, {inverse('j')[1]} AS clamp, total, from_legs, from_corr, r_gap, offer_clamp, round(phi, 9) AS phi, round(exp(ln(pa) + ln(pb) + ln(phi) - ln(pa * pb)), 9) AS legs FROM f"""
_BASE = "CASE WHEN n % 3 <> 0 THEN pb - 0.5 END"
_BLEND = lambda w: f"CASE WHEN r IS NULL THEN base WHEN base IS NULL THEN r ELSE {w} * r + (1 - {w}) * base END"
SQL["verdict_scalars"] = f"""WITH {ATT}, b AS (SELECT *, {_BASE} AS base FROM att) SELECT candidate_id, round(CASE WHEN base IS NULL OR n < 30 THEN coalesce(base, 0) ELSE {_BLEND('(CAST(n AS DOUBLE) / (n + 80))')} END, 9) AS r_blend, base IS NULL OR n < 30 AS fallback,
round(CASE WHEN n < 5 THEN base ELSE {_BLEND('(CAST(n AS DOUBLE) / (n + 50))')} END, 9) AS r_entity, round((coalesce(r, 0) + coalesce(base, 0)) / nullif((r IS NOT NULL)::INT + (base IS NOT NULL)::INT, 0), 9) AS r_mean,
CASE WHEN total > 8 THEN 'correlation_gap' WHEN total >= 3 THEN CASE WHEN from_legs > from_corr THEN 'leg_mispricing' ELSE 'correlation_gap' END WHEN total IS NOT NULL THEN 'marginal' END AS thesis, CASE WHEN r_gap > 0.05 THEN 'underpriced' WHEN r_gap < -0.05 THEN 'overpriced' WHEN r_gap IS NOT NULL THEN 'agrees' END AS gap,
CASE WHEN total < 0 THEN 'SKIP' WHEN total <= 5 OR n < 15 OR offer_clamp IS NOT NULL OR r_gap < -0.05 THEN 'MARGINAL' WHEN total > 5 THEN 'PLAY' END AS verdict, CASE WHEN total < 0 THEN 'SKIP' WHEN total > 5 AND n >= 5 THEN 'PLAY' WHEN total IS NOT NULL THEN 'MARGINAL' END AS dyad_verdict,
concat_ws(',', CASE WHEN pa > 0.10 THEN 'low_confidence' END, CASE WHEN n < 25 THEN 'small_sample' END, CASE WHEN total / 100 > 1 THEN 'outlier' END, CASE WHEN abs(pa - pb) > 0.20 THEN 'implausible_gap' END, CASE WHEN n % 2 > 0 THEN 'line_drift' END) AS badges FROM b"""
_GATE = "CASE WHEN status = 'awaiting' THEN 'game awaiting' WHEN n IS NULL THEN 'no data' WHEN n < 30 OR abs(coalesce(r, 0)) < 0.05 THEN 'below threshold' END"
SQL["candidate_pricing"] = f"""WITH {QD}, f AS (SELECT candidate_id, r, n, status, decimal_, coalesce(CASE WHEN candidate_id % 3 <> 0 THEN pa END, {novig('american', 'other', 'direction1')}) AS pa, coalesce(CASE WHEN candidate_id % 4 <> 0 THEN pb END, {novig('other', 'american', 'direction2')}) AS pb FROM q),
j AS (SELECT *, greatest({D('1e-6')}, least({D(0.999999)}, {_J})) AS pj FROM f WHERE pa IS NOT NULL AND pb IS NOT NULL), e AS (SELECT *, (pj * decimal_ - 1) * 100 AS ev, CASE WHEN decimal_ > 1 THEN (pj * decimal_ - 1) / (decimal_ - 1) END AS k FROM j)
SELECT candidate_id, round(pj, 9) AS p_joint, {_FAIR('pj')} AS fair_american, round(ev, 6) AS ev_pct, round(greatest({D(0)}, k) * 100, 6) AS kelly_pct, round(greatest({D(0)}, k * 0.25) * 100, 6) AS quarter_kelly_pct FROM e WHERE ({_GATE}) IS NULL AND ev / 100 >= {D(3)} / 100"""
SQL["candidate_funnel"] = f"WITH {QU} SELECT coalesce({_GATE}, 'with data') AS reason, count(*) AS n FROM q0 GROUP BY 1"
SQL["top_candidates"] = f"""WITH {QD}, e AS (SELECT candidate_id, r, round(({_J} * decimal_ - 1) * 100, 6) AS ev, CASE WHEN n % 2 = 0 THEN 'full_fv' ELSE 'hybrid' END AS kind FROM q ORDER BY abs(coalesce(r, 0)) DESC, candidate_id LIMIT 60)
SELECT * FROM e ORDER BY floor(ev / 0.5) DESC NULLS LAST, CASE WHEN kind = 'full_fv' THEN 0 ELSE 1 END, ev DESC NULLS LAST, candidate_id LIMIT 30"""

# The market tables of the sheets, each with what its rows without a stat are told.
_UNSUPPORTED, _COMBO = "unsupported_prop (no correlation data)", "multi-stat combo (skipped)"
_MARKETS = {
    "player": [("triple[- ]*double|double[- ]*double|points? *\\+ *rebounds? *\\+ *assists?|\\bpra\\b|points? *\\+ *rebounds?|points? *\\+ *assists?|rebounds? *\\+ *assists?", None, _UNSUPPORTED), ("3[- ]?(pointers?|pts?) *made|threes? *made|\\b3pm\\b", "3-Pointers Made", None),
        ("\\brebounds?\\b", "Rebounds", None), ("\\bassists?\\b", "Assists", None), ("\\bpoints?\\b", "Points", None), ("\\b(steals?|blocks?|turnovers?)\\b", None, _UNSUPPORTED)],
    "batter": [("hits? *\\+ *runs? *\\+ *rbi|runs? *\\+ *rbi", None, _COMBO), ("total *bases", "Total Bases", "1.5, 2.5, 3.5"), ("home *runs?", "Home Runs", "0.5"), ("stolen *bases?", "Stolen Bases", "0.5"), ("singles?", "Singles", "0.5"), ("doubles?", "Doubles", "0.5"), ("triples?", "Triples", "0.5"),
        ("\\brbi", "RBIs", "0.5, 1.5"), ("walks?", "Walks", "0.5"), ("\\bruns?\\b", "Runs", "0.5, 1.5"), ("\\bhits?\\b", "Hits", "0.5, 1.5, 2.5")],
    "pitcher": [("strikeout", "Strikeouts", "3.5, 4.5, 5.5, 6.5, 7.5"), ("earned *run", "Earned Runs", "1.5, 2.5, 3.5"), ("walk", "Walks", "1.5, 2.5, 3.5"), ("hits", "Hits Allowed", "3.5, 4.5, 5.5"), ("outs", "Outs Recorded", "14.5, 15.5, 16.5, 17.5, 18.5")],
}
_BET = r"'(?i)^(.*?)\s+(over|under)\s+(\d+(?:\.\d+)?)'"
_SIDE = lambda c: f"CASE WHEN lower(trim({c})) IN ('over', 'o') THEN 'Over' WHEN lower(trim({c})) IN ('under', 'u') THEN 'Under' END"


def sheet_rows(kind: str) -> str:
    """CTEs up to sn: the rows of a kind of sheet with what was read and the first reason to leave a row out."""
    table, markets = {"player": "sheet"}.get(kind, f"{kind}_sheet"), _MARKETS[kind]
    when = lambda of: "CASE " + " ".join(f"WHEN regexp_matches(lower(market), '{e[0]}') THEN {of(e)}" for e in markets) + " END"
    quoted = lambda x: f"'{x}'" if x else "NULL"
    stat, dropped = when(lambda e: quoted(e[1])), when(lambda e: "NULL" if e[1] else quoted(e[2]))
    offered = " OR ".join(f"stat = '{e[1]}' AND line IN ({e[2]})" for e in markets if e[1] and e[2]) or "TRUE"
    name = {"pitcher": "CASE WHEN bd IS NOT NULL AND bp IS NOT NULL THEN bp ELSE ep END", "batter": "nullif(trim(regexp_replace(strip_accents(ep), '[^A-Za-z0-9]+', ' ', 'g')), '')", "player": "ep"}[kind]
    direction, line = ("coalesce(bd, ed)", "CASE WHEN bd IS NOT NULL THEN bl ELSE el END") if kind == "pitcher" else ("coalesce(ed, bd)", "coalesce(el, bl)")
    differ = "coalesce(ed <> bd, FALSE) OR coalesce(el <> bl, FALSE)" + (" OR coalesce(lower(ep) <> lower(bp), FALSE)" if kind == "pitcher" else "")
    no_leg, known = "direction IS NULL OR line IS NULL", f"stat IS NULL AND dropped IS NULL"
    reason = {
        "player": f"WHEN player IS NULL THEN 'no player name' WHEN dropped IS NOT NULL THEN dropped WHEN {known} THEN 'unknown NBA market' WHEN {no_leg} THEN 'missing direction/line'",
        "batter": f"WHEN player IS NULL THEN 'no batter name' WHEN {no_leg} OR market IS NULL THEN 'missing fields' WHEN dropped IS NOT NULL THEN dropped WHEN {known} THEN 'unknown market' WHEN NOT ({offered}) THEN 'line not valid'",
        "pitcher": f"WHEN {no_leg} OR market IS NULL THEN 'missing fields' WHEN {known} THEN 'unknown market' WHEN NOT ({offered}) THEN 'line not offered' WHEN player IS NULL THEN 'no pitcher name'",
    }[kind]
    return f"""s0 AS ({adapted_sql(table)}), dr AS (SELECT sheet_id, count(*) AS n, count(*) FILTER (try_cast(avg_fv AS DOUBLE) IS NULL) AS bad FROM s0 GROUP BY sheet_id),
s1 AS (SELECT s0.* EXCLUDE (market, team, game), nullif(trim(market), '') AS market, nullif(trim(team), '') AS team, nullif(trim(game), '') AS game, nullif(trim(player), '') AS ep, {_SIDE('direction')} AS ed, try_cast(trim(line) AS DOUBLE) AS el, nullif(trim(regexp_extract(bet_name, {_BET}, 1)), '') AS bp, CASE lower(regexp_extract(bet_name, {_BET}, 2)) WHEN 'over' THEN 'Over' WHEN 'under' THEN 'Under' END AS bd, try_cast(nullif(regexp_extract(bet_name, {_BET}, 3), '') AS DOUBLE) AS bl,
try_cast(trim(avg_fv) AS DOUBLE) AS fv, CASE WHEN isfinite(try_cast(trim(books_count) AS DOUBLE)) THEN try_cast(trim(books_count) AS DOUBLE) ELSE 0 END AS books, CASE WHEN isfinite(try_cast(trim(L) AS DOUBLE)) THEN try_cast(trim(L) AS DOUBLE) END AS row_id, CASE WHEN L IS NULL OR L = '' THEN 'idx' || CAST(idx AS VARCHAR) ELSE L END AS row_key, CAST(regexp_extract(avg_odds, '([+-]?[0-9]+) / ([+-]?[0-9]+)', 1) AS BIGINT) AS o1, CAST(regexp_extract(avg_odds, '([+-]?[0-9]+) / ([+-]?[0-9]+)', 2) AS BIGINT) AS o2 FROM s0 JOIN dr USING (sheet_id) WHERE dr.n < 10 OR dr.bad * 5 <= dr.n),
s2 AS (SELECT sheet_id, idx, row_id, row_key, team, game, {name} AS player, {direction} AS direction, {line} AS line, market, {stat} AS stat, {dropped} AS dropped, fv, books, {differ} AS disagree, coalesce(fv = o1 OR fv = o2, FALSE) AS suspicious FROM s1),
sn AS (SELECT *, CASE {reason} WHEN fv IS NULL THEN 'avg_fv not numeric' END AS reason FROM s2)"""


SN = sheet_rows("player")
SH = SN.split(", dr AS")[0] + ", dr AS" + SN.split(", dr AS")[1].split(",\ns1")[0]
_DEDUPE = lambda tie: f"d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, player, row_key ORDER BY idx) AS k1 FROM sn WHERE reason IS NULL) WHERE k1 = 1), d2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, player, stat, direction, line ORDER BY books DESC, coalesce(row_id, -1) {tie}, idx) AS k2, min(idx) OVER (PARTITION BY sheet_id, player, stat, direction, line) AS seen FROM d1) WHERE k2 = 1)"
_OF = lambda d, c: f"max(CASE WHEN direction = '{d}' THEN {c} END)"
SQL["sheet_drift"] = f"WITH {SH} SELECT sheet_id, n, bad, n < 10 OR bad * 5 <= n AS ok FROM dr"
for _name, _kind in (("sheet_rows", "player"), ("batter_rows", "batter"), ("pitcher_rows", "pitcher")):
    SQL[_name] = f"WITH {sheet_rows(_kind)} SELECT idx, player, team, game, direction, line, stat, fv, books, disagree, suspicious, reason FROM sn"
SQL["pitcher_legs"] = f"WITH {sheet_rows('pitcher')}, {_DEDUPE('ASC')} SELECT sheet_id, player, direction, line, stat, fv, suspicious FROM d2"
SQL["sheet_reasons"] = f"WITH {SN} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM sn GROUP BY 1"
SQL["sheet_props"] = f"""WITH {SN}, {_DEDUPE('DESC')} SELECT sheet_id, player, stat, line AS threshold, {_OF('Over', 'fv')} AS over_fv, {_OF('Under', 'fv')} AS under_fv, {_OF('Over', 'books')} AS over_books_count, {_OF('Under', 'books')} AS under_books_count, {_OF('Over', 'row_id')} AS "over_L", {_OF('Under', 'row_id')} AS "under_L",
bool_or(CASE WHEN direction = 'Over' THEN suspicious END) AS over_fv_suspicious, bool_or(CASE WHEN direction = 'Under' THEN suspicious END) AS under_fv_suspicious FROM d2 GROUP BY sheet_id, player, stat, line"""
_FIRST = lambda c: f"arg_min({c}, seen) FILTER ({c} IS NOT NULL) AS {c}"
for _name, _kind in (("sheet_players", "player"), ("batter_players", "batter")):
    SQL[_name] = f"""WITH {sheet_rows(_kind)}, {_DEDUPE('DESC')}, w AS (SELECT sheet_id, player, {_FIRST('team')}, {_FIRST('game')} FROM d2 GROUP BY sheet_id, player), g AS (SELECT DISTINCT sheet_id, player, stat, line FROM d2)
SELECT sheet_id, player, w.team, w.game, CAST(count(*) AS INT) AS n, string_agg(stat || '@' || CAST(line AS VARCHAR), ';' ORDER BY stat, line) AS props FROM g JOIN w USING (sheet_id, player) GROUP BY ALL"""
SQL["props_per_player"] = f"WITH {SN}, {_DEDUPE('DESC')}, g AS (SELECT DISTINCT sheet_id, player, stat, line FROM d2), c AS (SELECT sheet_id, player, count(*) AS props FROM g GROUP BY ALL) SELECT props, count(*) AS players FROM c GROUP BY props"
SQL["sheet_coverage"] = f"WITH {SN} SELECT stat, count(*) AS n, count(DISTINCT player) AS players, count(*) FILTER (suspicious) AS suspicious FROM sn WHERE reason IS NULL GROUP BY stat"

_NUM = lambda c: f"CASE WHEN NOT isnan(try_cast({c} AS DOUBLE)) THEN try_cast({c} AS DOUBLE) END"
UP = f"""u0 AS ({adapted_sql('uploads')}), up AS (SELECT *, CASE WHEN trim(Player_1) = '' OR trim(Player_2) = '' THEN 'missing player name' WHEN trim(Player_1) <> trim(Player_2) THEN 'cross-player row' WHEN ({_SIDE('Side_1')}) IS NULL OR ({_SIDE('Side_2')}) IS NULL THEN 'invalid side' WHEN trim(Prop_1) = '' OR trim(Prop_2) = '' THEN 'missing prop'
WHEN ({_NUM('Line_1')}) IS NULL OR ({_NUM('Line_2')}) IS NULL THEN 'non-numeric line' WHEN coalesce({_NUM('Total_Games')}, 0) < 1 THEN 'too few games' WHEN NOT coalesce(({_NUM('Empirical_Prob')}) BETWEEN 0 AND 1, FALSE) THEN 'joint probability out of range' WHEN NOT coalesce(({_NUM('P_Value')}) BETWEEN 0 AND 1, FALSE) THEN 'p-value out of range' END AS reason FROM u0),
en AS (SELECT id, trim(Player_1) AS player, Prop_1 || '|' || ({_SIDE('Side_1')}) AS k1, Prop_2 || '|' || ({_SIDE('Side_2')}) AS k2, {_NUM('Line_1')} AS l1, {_NUM('Line_2')} AS l2, CAST({_NUM('Total_Games')} AS INT) AS games, {_NUM('Hit_Rate_1')} AS h1, {_NUM('Hit_Rate_2')} AS h2 FROM up WHERE reason IS NULL)"""
SQL["upload_rejects"] = f"WITH {UP} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, count(DISTINCT trim(Player_1)) AS players FROM up GROUP BY 1"
SQL["upload_index"] = f"WITH {UP} SELECT player, least(k1, k2) || '#' || greatest(k1, k2) AS pair, CAST(count(*) AS INT) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM en GROUP BY 1, 2"
SQL["nearest_lines"] = f"""WITH {UP}, ti AS (SELECT id AS ticket, Player_1 AS player, Prop_2 || '|' || ({_SIDE('Side_2')}) AS t1, id % 6 + 0.5 AS w1, Prop_1 || '|' || ({_SIDE('Side_1')}) AS t2, id % 4 + 0.5 AS w2 FROM u0),
x AS (SELECT ticket, id, games, k1 = t1 AS s, CASE WHEN k1 = t1 THEN l1 ELSE l2 END AS m1, CASE WHEN k1 = t1 THEN l2 ELSE l1 END AS m2, w1, w2, CASE WHEN k1 = t1 THEN h1 ELSE h2 END AS r1, CASE WHEN k1 = t1 THEN h2 ELSE h1 END AS r2 FROM ti JOIN en ON en.player = ti.player AND (k1 = t1 AND k2 = t2 OR k1 = t2 AND k2 = t1)),
b AS (SELECT * FROM (SELECT *, abs(m1 - w1) + abs(m2 - w2) AS drift, row_number() OVER (PARTITION BY ticket ORDER BY abs(m1 - w1) + abs(m2 - w2), games DESC, id) AS k FROM x) WHERE k = 1)
SELECT ti.ticket, b.id AS entry_id, drift, drift = 0 AS exact, games AS n_games, r1 AS hit_rate_1, r2 AS hit_rate_2 FROM ti LEFT JOIN b USING (ticket)"""

_PLAIN = lambda c: f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_DIR = "CASE WHEN outcomeType IN ('Over', 'Under') THEN outcomeType WHEN regexp_matches(lower(outcomeType), 'fewer|or less|at most') THEN 'Under' WHEN regexp_matches(lower(outcomeType), 'or more|at least') OR outcomeType LIKE '%+' THEN 'Over' END"
_HAS = lambda blob, *words: "(" + " OR ".join(f"contains({blob}, '{w}')" for w in words) + ")"
_P = _HAS("cls", "strikeout", "earned run", "walks", "walk ", "hits allowed", "pitching out", "pitcher", "outs recorded", "outs o/u", "outs thrown")
_IS = {
    "pitcher": f"{_P} AND NOT {_HAS('cls', 'rbi', 'total bases', 'home run', 'at bat', 'stolen base', 'singles', 'doubles', 'triples', 'batting')}",
    "batter": f"{_HAS('cls', 'hits', 'runs', 'rbi', 'total bases', 'home run', 'at bat', 'stolen base', 'singles', 'doubles', 'triples', 'walks', 'batter', 'hitter')} AND NOT {_P} AND NOT contains(cls, 'team')",
    "player": f"{_HAS('cls', 'points', 'rebounds', 'assists', 'pointers', '3-point', 'three-point', '3 pt', 'threes')} AND NOT {_HAS('cls', 'team', 'quarter', 'half', '1st', '2nd', '3rd', '4th', 'race to', 'parlay', 'double-double', 'triple-double', 'pra', 'steal', 'block', 'turnover', 'combo')}",
}
_SHELF_P = ("pitcher", "pitching", "strikeout", "earned run", "walks allowed", "walk allowed", "hits allowed", "outs recorded", "outs o/u", "outs thrown")
_SHELF_NOT = ("team total", "moneyline", "run line", "game prop", "game lines", "first inning", "first 5", "1st 5", "innings")
_KEEPS = {
    "pitcher": f"{_HAS('shelf', *_SHELF_P)} AND NOT {_HAS('shelf', 'batter', 'hitter', 'home run', 'rbi', 'total bases', 'at bat', 'stolen base', 'singles', 'doubles', 'batting', *_SHELF_NOT, 'player combo', 'alternate run', 'parlay', 'quick pick')}",
    "batter": f"{_HAS('shelf', 'hits', 'runs', 'rbi', 'total bases', 'home run', 'at bat', 'stolen base', 'singles', 'doubles', 'triples', 'walks', 'batter', 'hitter', 'batting', 'extra base')} AND NOT {_HAS('shelf', *_SHELF_P, *_SHELF_NOT, 'team to', 'spread')}",
    "player": f"{_HAS('shelf', 'points', 'rebounds', 'assists', 'pointers', 'three-point', '3-point', '3 pt', 'threes')} AND NOT {_HAS('shelf', 'team total', 'team to', 'moneyline', 'spread', 'game prop', 'game lines', 'quarter', 'half', 'parlay', 'quick pick', 'race to', 'alternate', 'steals', 'blocks', 'turnovers', 'double-double', 'triple-double', 'same game', 'player combo', 'pra', 'points+', 'points +')}",
}
MK = f"""s00 AS (SELECT *, {_PLAIN("coalesce(player, '')")} AS pb, {_DIR} AS dir, lower(marketName || ' ' || coalesce(subcategory, '') || ' ' || marketType) AS blob, lower(marketName || ' ' || marketType || ' ' || coalesce(subcategory, '')) AS cls, lower(coalesce(subcategory, '')) AS shelf FROM ({adapted_sql('selections')})),
se AS (SELECT *, {_IS['pitcher']} AS is_pitcher, {_IS['batter']} AS is_batter, {_IS['player']} AND NOT ({_IS['pitcher']}) AND NOT ({_IS['batter']}) AS is_player, {', '.join(f'{v} AS keeps_{k}' for k, v in _KEEPS.items())} FROM s00), lg AS (SELECT *, {_PLAIN('player')} AS pa FROM ({adapted_sql('legs')}))"""
_STATOK = {
    "pitcher": "CASE WHEN contains(s, 'earned run') THEN contains(blob, 'earned run') WHEN contains(s, 'hits allowed') OR s = 'hits' THEN contains(blob, 'hits') AND (contains(blob, 'pitch') OR contains(blob, 'allow')) WHEN contains(s, 'walk') THEN contains(blob, 'walk') WHEN contains(s, 'strikeout') THEN contains(blob, 'strikeout') WHEN contains(s, 'out') THEN contains(replace(replace(blob, 'strikeouts', ''), 'strikeout', ''), 'outs') ELSE FALSE END",
    "batter": "CASE WHEN contains(s, 'total base') OR s = 'tb' THEN contains(blob, 'total base') WHEN contains(s, 'home run') OR s = 'hr' THEN contains(blob, 'home run') WHEN contains(s, 'stolen base') OR s = 'sb' THEN contains(blob, 'stolen base') WHEN contains(s, 'single') OR s = '1b' THEN contains(blob, 'single') WHEN contains(s, 'double') OR s = '2b' THEN contains(blob, 'double') WHEN contains(s, 'triple') OR s = '3b' THEN contains(blob, 'triple') WHEN contains(s, 'rbi') THEN contains(blob, 'rbi') WHEN contains(s, 'walk') OR s = 'bb' THEN contains(blob, 'walk') WHEN s IN ('runs', 'r') THEN contains(blob, 'runs') AND NOT contains(blob, 'home run') AND NOT contains(blob, 'rbi') WHEN s IN ('hits', 'h') THEN contains(blob, 'hits') ELSE FALSE END",
    "player": "CASE WHEN contains(s, '3-point') OR contains(s, 'three') OR s = '3pm' THEN contains(blob, '3-point') OR contains(blob, '3 point') OR contains(blob, 'threes') OR contains(blob, 'pointers') OR contains(blob, '3pt') OR contains(blob, '3 pt') WHEN s = 'points' THEN contains(blob, 'point') AND NOT (contains(blob, '3-point') OR contains(blob, '3 point') OR contains(blob, 'three') OR contains(blob, 'pointers') OR contains(blob, 'rebound') OR contains(blob, 'assist')) WHEN s = 'rebounds' THEN contains(blob, 'rebound') AND NOT contains(blob, 'assist') AND NOT contains(blob, 'point') WHEN s = 'assists' THEN contains(blob, 'assist') AND NOT contains(blob, 'rebound') AND NOT contains(blob, 'point') ELSE FALSE END",
}
_LAST = lambda c: f"split_part({c}, ' ', -1)"
_NAME = f"(pa <> '' AND pb <> '' AND (pa = pb OR {_LAST('pa')} = {_LAST('pb')} AND (contains(pa, ' ') AND contains(pb, ' ') AND substr(pa, 1, 1) = substr(pb, 1, 1) OR length({_LAST('pa')}) > 3)))"


def _leg_match(kind: str, points: str, order: str) -> str:
    return f"WITH {MK}, m AS (SELECT leg_id, selectionId, row_number() OVER (PARTITION BY leg_id ORDER BY {order}) AS k FROM (SELECT *, lower(trim(stat)) AS s FROM lg) JOIN se ON {_NAME} AND dir = direction AND {points} AND is_{kind} AND {_STATOK[kind]}) SELECT lg.leg_id, selectionId FROM lg LEFT JOIN m ON m.leg_id = lg.leg_id AND k = 1"


def _leg_sides(kind: str, points: str, order: str) -> str:
    whole = _leg_match(kind, points, order).split(" SELECT lg.leg_id")[0].replace("SELECT leg_id, selectionId,", "SELECT leg_id, player_ AS leg_player, pa, direction, s, selectionId, pts, coalesce(subcategory, '') AS sub, oddsAmerican,").replace("lower(trim(stat)) AS s FROM lg", "lower(trim(stat)) AS s, player AS player_ FROM lg")
    return f"""{whole}, a AS (SELECT * FROM m WHERE k = 1),
o AS (SELECT a.leg_id, se.selectionId, se.oddsAmerican, row_number() OVER (PARTITION BY a.leg_id ORDER BY se.feed_pos) AS k FROM a JOIN se ON {_NAME} AND se.dir <> a.direction AND se.pts = a.pts AND coalesce(se.subcategory, '') = a.sub AND is_{kind} AND {_STATOK[kind]})
SELECT lg.leg_id, a.selectionId, o.selectionId AS opposite_id, {_AM("CASE WHEN a.direction = 'Over' THEN a.oddsAmerican ELSE o.oddsAmerican END")} AS over_odds, {_AM("CASE WHEN a.direction = 'Over' THEN o.oddsAmerican ELSE a.oddsAmerican END")} AS under_odds
FROM lg LEFT JOIN a ON a.leg_id = lg.leg_id LEFT JOIN o ON o.leg_id = lg.leg_id AND o.k = 1"""


_AM = lambda c: f"CAST(replace(replace({c}, '−', '-'), '+', '') AS BIGINT)"
_HALF = "(pts = thr OR pts = CASE WHEN direction = 'Over' THEN thr + 0.5 ELSE thr - 0.5 END)"
SQL["leg_matches"] = _leg_match("pitcher", _HALF, "feed_pos")
SQL["batter_leg_matches"] = _leg_match("batter", _HALF, "CASE WHEN contains(shelf, 'o/u') THEN 0 ELSE 1 END, feed_pos")
SQL["exact_leg_matches"] = _leg_match("player", "pts = thr", "feed_pos")
SQL["batter_sides"] = _leg_sides("batter", _HALF, "CASE WHEN contains(shelf, 'o/u') THEN 0 ELSE 1 END, feed_pos")
SQL["player_sides"] = _leg_sides("player", "pts = thr", "feed_pos")
SQL["opposite_odds"] = f"""WITH {MK}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player, marketName, pts, coalesce(subcategory, ''), dir ORDER BY feed_pos) AS k FROM se) WHERE k = 1)
SELECT se.selectionId, {_AM("CASE WHEN se.dir = 'Over' THEN se.oddsAmerican ELSE f.oddsAmerican END")} AS over_odds, {_AM("CASE WHEN se.dir = 'Over' THEN f.oddsAmerican ELSE se.oddsAmerican END")} AS under_odds
FROM se LEFT JOIN f ON f.player = se.player AND f.marketName = se.marketName AND f.pts = se.pts AND coalesce(f.subcategory, '') = coalesce(se.subcategory, '') AND f.dir <> se.dir"""
_CLASSES = ", ".join(f"{a}_{k}" for a in ("is", "keeps") for k in ("pitcher", "batter", "player"))
SQL["market_classes"] = f"WITH {MK} SELECT marketName, subcategory, {_CLASSES}, count(*) AS n FROM se GROUP BY ALL"
BX = f"bx AS ({adapted_sql('box')})"
SQL["starters"] = f"WITH {BX}, s AS (SELECT *, ord // 100 AS slot, row_number() OVER (PARTITION BY gid, team_id ORDER BY ord // 100, player) AS k FROM bx WHERE ord % 100 = 0 AND ord > 0) SELECT gid, team_id, count(*) AS n, CAST(min(slot) AS INT) AS lo, CAST(max(slot) AS INT) AS hi, CAST(sum(player) AS BIGINT) AS players FROM s WHERE k <= 9 GROUP BY gid, team_id"
SQL["look_back"] = f"WITH g AS ({adapted_sql('games')}), w AS (SELECT DISTINCT team_id, d FROM g), x AS (SELECT w.team_id, w.d, g.gid, g.d AS past, row_number() OVER (PARTITION BY w.team_id, w.d ORDER BY g.d DESC, g.gid DESC) AS k FROM w JOIN g ON g.team_id = w.team_id AND g.state = 'Final' AND g.d < w.d AND g.d >= w.d - 3) SELECT team_id, CAST(d AS VARCHAR) AS d, gid, CAST(past AS VARCHAR) AS past FROM x WHERE k = 1"
SQL["slate_coverage"] = f"WITH {BX}, c AS (SELECT team_id, count(DISTINCT player) AS players FROM bx GROUP BY team_id) SELECT team_id, players, players * (players - 1) // 2 AS pairs FROM c"
SQL["folded_names"] = "SELECT lower(trim(regexp_replace(strip_accents(name), '[^A-Za-z0-9]+', ' ', 'g'))) AS key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT name, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), ' ')) AS name FROM documents) GROUP BY name) GROUP BY 1"
SQL["stream_moments"] = "SELECT CAST(year(ts) AS INT) AS season, user_id AS p, count(*) AS n, CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS n1, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS n2, CAST(sum(CASE WHEN value > 20 AND event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS n11 FROM events GROUP BY 1, 2"
SQL["stream_requests"] = "SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(user_id AS VARCHAR) || ':' || event_type AS fingerprint, count(*) AS n FROM events WHERE time_bucket(INTERVAL '10 minutes', ts) <= (SELECT max(ts) FROM events) - INTERVAL '20 minutes' GROUP BY 1, 2"
SQL["stream_fresh"] = "SELECT DISTINCT CAST(user_id AS VARCHAR) || ':' || event_type AS fingerprint FROM events"
SQL["stream_reuse"] = """WITH RECURSIVE e AS (SELECT event_id AS request_id, ts, event_type || ':' || CAST(user_id % 10 AS VARCHAR) AS fingerprint, event_id % 7 <> 0 AS ok, row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT request_id, fingerprint, n, FALSE AS cached, ts, CASE WHEN ok THEN ts END AS kept, CASE WHEN ok THEN ts END AS source FROM e WHERE n = 1
      UNION ALL SELECT request_id, fingerprint, n, hit, ts, CASE WHEN NOT hit AND ok THEN ts ELSE kept END, kept FROM (
          SELECT e.*, w.kept, w.kept IS NOT NULL AND e.ts < w.kept + INTERVAL 10 MINUTE AS hit FROM w JOIN e ON e.fingerprint = w.fingerprint AND e.n = w.n + 1))
SELECT request_id, fingerprint, cached, CASE WHEN cached THEN (date_diff('microsecond', source, ts) + 500000) // 1000000 ELSE 0 END AS age_s FROM w"""
SQL["season_refresh"] = f"SELECT season, p, count(*) AS n, CAST(count_if(K > 24.5) AS BIGINT) AS n1, CAST(count_if(ER > 4.5) AS BIGINT) AS n2, CAST(count_if(K > 24.5 AND ER > 4.5) AS BIGINT) AS n11 FROM ({adapted_sql('starts')}) WHERE upper(trim(flag)) = 'YES' AND ip > 0 GROUP BY season, p"
SQL["entity_build"] = SQL["entity_means"]
